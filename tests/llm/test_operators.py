"""The training-data operators on small fixtures: brute force, round trips, and odd rows (nulls, empties, repeats, clashing names)."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import decontaminate, language_id, language_model, media, packing, quality, simhash, token_counts, token_records, url_filter
from tracewright.llm.tokenization import UnitTokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h long"
WORDS = "the of and to in that house river stone water light garden teacher".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "!!"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, very long, repeated, without letters; names that operators use inside."""
    rng = random.Random(3)
    long_text = sentence(rng, 30_000)
    rows = [(1, None, None, None, None, 1, 1), (2, "", "en", "s", 0, 1, 1), (None, "some words here and there", "en", None, 5, 1, 1), (4, long_text, "en", "s", 1, 1, 1), (5, "  \n\t ", "fr", "s", 1, 1, 1), (6, "1234 !!", "fr", "s", 1, 1, 1), (7, "Ünï çödé ▁ 中文 😀 <|endoftext|> İ ſ", "de", "s", 1, 1, 1)]
    rows += [(8, "the same words again and again", "en", "s", 1, 1, 1)] * 2 + [(9, "the same words again and again", "en", "s", 1, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def vocabulary(name):
    return public_tokenizers.path(name)


def test_tokenizer_units_match_the_library():
    rng = random.Random(5)
    alphabet = "abcdeéüñ  \n\t.,!'’s<|0159İſ中😀 -"
    found = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", " ", "  a", "a  b \n c", "it's we'll DON'T", "<|endoftext|> x", "a\n\n b", "x" * 500]
    for name, space in (("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")):
        ours = UnitTokenizer(vocabulary(name), space)
        theirs = Tokenizer.from_file(vocabulary(name))
        for _ in range(2):  # the second time from the tables
            for x, raw in zip(found, ours.encode(found), strict=True):
                assert np.frombuffer(raw, "<u2").tolist() == theirs.encode(x, add_special_tokens=False).ids, x


def test_prefix_counts_match_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    c = token_counts.PrefixCounter(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(6)
    found = ["".join(rng.choice("abcdeht  \n.é€😀中▁<s>oun'01") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", " ", "   a", "a ", "<s> </s>", "a" * 300]
    for x in found:
        assert c.table(x).tolist() == [len(sp.encode(x[:i])) for i in range(len(x) + 1)], x
        for _ in range(2):  # the second time from the tables
            assert c.table(x)[-1] == len(sp.encode(x))
    rng = random.Random(8)  # words with punctuation after them, which go on from the word's table
    for x in (" ".join("".join(rng.choice("abcdehtou") for _ in range(rng.randint(0, 9))) + rng.choice(["", ".", ",", "...", "!?", "'s", "---", "$$$", ");"]) for _ in range(12)) for _ in range(200)):
        assert c.table(x).tolist() == [len(sp.encode(x[:i])) for i in range(len(x) + 1)], x


def test_prefix_tables_answer_budgets(spark, odd, none):
    path = vocabulary("piece_bpe_32k.model")
    tables = token_counts.prefix_tables(odd.where("doc_id <> 4"), path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in token_counts.ask(tables, 3).collect():
        fits = [i for i in range(len(texts[r.doc_id]) + 1) if len(sp.encode(texts[r.doc_id][:i])) <= 3]
        assert r.n_chars_kept == max(fits)
    counts = {r.doc_id: r for r in token_counts.count_tokens(odd, path, 4096).collect()}
    assert counts[1].n_tokens == 0 and counts[4].over_limit and counts[7].n_tokens == len(sp.encode(texts[7]))
    assert token_counts.count_tokens(none, path).count() == 0


def test_language(spark, odd, none):
    rng = random.Random(1)
    stems = {"xx": ["thra", "onti", "ould"], "yy": ["schö", "keit", "ung"], "zz": ["ción", "amos", "que"]}
    text = lambda k: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randint(1, 3))) for _ in range(40))
    rows = [(i, text(k), k) for i, k in enumerate(list(stems) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id < 120"))
    found = language_id.identify(df, model).join(df, "doc_id").where("doc_id >= 120")
    assert found.where("lang = lang_pred").count() > 0.95 * found.count()
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert {got[i].lang_pred for i in (1, 2, 5, 6)} == {"und"} and got[4].lang_pred in stems
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 5, 6})
    assert language_id.fit(none) == {} and language_id.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(none, model).count() == 0
    assert language_id.Classifier({"xx": b"enough of a dictionary"}).judge("abc") == ("xx", 1.0, True)


def test_records(spark, odd, none, tmp_path):
    path = vocabulary("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    manifest = token_records.write_records(odd, f"file://{tmp_path}/r", path, 1)
    found = sorted(token_records.read_records(manifest).collect(), key=lambda r: (r.start))
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, own in zip(found, rows, strict=True):
        ids = np.array([*theirs.encode(own.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (own.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    m = manifest.where("n_records > 0").first()
    assert m.path.startswith("file:")
    fs, place = token_records.file_system(m.path)
    index = np.frombuffer(open(place + ".idx", "rb").read(), "<u8").reshape(-1, 2)
    whole = open(place, "rb").read()
    for at, n in index[::-1].tolist():
        doc_id, ids = token_records.read_one(fs, place, at, n)
        assert ids[-1] == 1
        broken = bytearray(whole[at : at + n])
        broken[-6] ^= 1
        with pytest.raises(ValueError):
            token_records.unframed(bytes(broken))
    assert token_records.token_records(none, path).count() == 0


def test_media(spark, odd, none):
    for n in (0, 1, 63, 64, 65, 1024, 1025, 70_000):
        length, payload = media.padded("x" * n)
        assert length == n and len(payload) % 64 == 0 and len(payload) >= 64 and (n % 64 or n == 0 or len(payload) == n)
        data = media.store(payload)
        t = media.tracks(data)[0]
        assert b"".join(data[a : a + s] for a, s in zip(t["offset"], t["size"], strict=True)) == payload
        assert t["keyframe"][::16].all() and t["keyframe"].sum() == -(-len(t["size"]) // 16)
        for cut in (3, 30, len(data) // 3, len(data) - 1):
            try:
                media.tracks(data[:cut])
            except (ValueError, IndexError, __import__("struct").error):
                pass
    rows = {r.doc_id: r for r in media.digests(media.stored(odd)).collect()}
    assert rows[1].payload_bytes == 64 and rows[1].n_bytes == 0 and rows[8].feature == rows[9].feature and rows[8].media_sha256 == rows[9].media_sha256
    assert media.digests(media.stored(none)).count() == 0
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"nonsense")), (3, bytearray(media.store(bytes(128)))), (4, bytearray(b""))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.index(bad).collect()}
    assert got[1].error is None and got[1].codec is None and got[2].error and got[4].error and got[3].codec == "raw " and got[3].keyframes[0].length == 64


def test_packing(spark, odd, none):
    path = vocabulary("byte_bpe_50k.json")
    found = packing.pack_documents(odd, path, 256).toPandas()
    theirs = Tokenizer.from_file(path)
    want = sorted(len(theirs.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert found.length.sum() == sum(want)
    for _, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.length.cumsum() - g.length).tolist() == g.offset.tolist() and g.length.sum() <= 256
    pieces = found[found.doc_id == 4].sort_values("piece")
    assert (pieces.length.iloc[1:] == 256).all() and (pieces.length.cumsum() - pieces.length).tolist() == pieces.start.tolist()
    assert packing.pack_documents(none, path).count() == 0


def test_plans_are_near_the_bound():
    rng = np.random.default_rng(2)
    for scale in (300, 30_000):
        lengths = np.clip(rng.lognormal(6, 1, scale).astype(int), 1, 2048)
        counts = np.bincount(lengths, minlength=2049)
        made = packing.plan(counts)
        used = np.zeros(2049, int)
        for own, n in made:
            assert sum(own) <= 2048
            np.add.at(used, own, n)
        assert (used == counts).all()
        assert sum(n for _, n in made) <= math.ceil(lengths.sum() / 2048) * 1.02 + 1


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(xxhash.xxh64_intdigest(x, 42) >> k & 1 for x in s) > len(s)) if s else 0


def test_simhash(spark, odd, none):
    rng = random.Random(9)
    base = [sentence(rng, 120) for _ in range(6)]
    rows = []
    for i in range(90):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.cluster(df).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert all(found[i].fingerprint == f"{p:016x}" for i, p in prints.items())
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(found[i].component_id == root(i) for i in prints)
    kept = simhash.keep_first(df)
    assert {r.doc_id for r in kept.collect()} == {root(i) for i in prints}
    got = simhash.cluster(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id in (1, 2, 5)} == {1} and all(r.fingerprint == "0" * 16 for r in got if r.doc_id == 1)
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 6, 7, 8] and kept.where("doc_id IS NULL").count() == 1
    assert simhash.cluster(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_links_at_every_choice_of_bits():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    far = np.array([int(f) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for f, k in zip(fps, rng.integers(0, 6, 300), strict=True)], np.uint64)
    masks = np.array(simhash.masks(3), np.int64).view(np.uint64)
    for a, b in zip(fps, far, strict=True):
        if int(np.bitwise_count(a ^ b)) <= 3:
            assert ((a & masks) == (b & masks)).any()
    every = np.unique(np.concatenate([fps[:60], far[:60]]))
    linked = {x for pair in simhash.stars(every, 3) for x in pair}
    for i, a in enumerate(every):
        near = (np.bitwise_count(every ^ a) <= 3).sum() > 1
        assert near == (int(a.view(np.int64)) in linked)


def test_decontamination(spark, odd, none):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (16, 25, 40, 60, 3)]
    items = spark.createDataFrame([*enumerate(texts), (7, None), (8, "")], "item_id long, text string")
    docs = []
    for i in range(120):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([10, 200, 4000]))]
        if i % 2:
            own = texts[rng.randrange(4)].split()
            if i % 3 == 0:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = own
        docs.append((i, " ".join(w) if i % 5 else "\n".join(w)))
    docs += [(500, texts[4]), (501, texts[4] + " more"), (None, texts[0]), (502, texts[1]), (502, texts[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for i, t in docs:
        for j, x in enumerate(texts):
            own = shingles(x)
            if len(own & shingles(t)) >= 0.8 * len(own):
                want.add((i, j))
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(df, items).collect()} == want
    clean = decontaminate.keep_clean(df, items)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.find(none, items).count() == 0 and decontaminate.find(odd, items.limit(0)).count() == 0
    assert decontaminate.keep_clean(odd, items).count() == odd.count()


def test_decontamination_finds_short_items_in_long_documents(spark):
    rng = random.Random(21)
    texts = [" ".join(f"s{i}x{k}" for k in range(5 + i % 5)) for i in range(60)]
    items = spark.createDataFrame([*enumerate(texts)], "item_id long, text string")
    docs = []
    for i, x in enumerate(texts):
        w = [f"w{rng.randrange(50_000)}" for _ in range(2000 + 50 * i)]
        w[700:700] = x.split()
        docs.append((i, " ".join(w)))
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(60)} and all(r.containment == 1 for r in found)


def test_stages_decide_by_row(spark):
    rng = random.Random(31)
    free = lambda n=60: " ".join(f"f{rng.randrange(100_000)}" for _ in range(n))
    item, near = free(), free(900).split()
    copies = [" ".join(near[:k] + ["other"] + near[k + 1 :]) for k in range(0, 900, 10)]
    prints = {x: simhash.fingerprint(x) for x in copies}
    first = copies[0]
    linked = next(x for x in copies if 0 < (prints[x] ^ prints[first]).bit_count() <= 3)
    clean = [free() for _ in range(4)]
    schema = "doc_id long, text string"
    # an id of two unlinked texts, nulls of two unlinked texts, and near copies without an id
    rows = [(1, clean[0]), (1, clean[1]), (None, clean[2]), (None, clean[3]), (None, first), (None, linked)]
    kept = sorted((r.text for r in simhash.keep_first(spark.createDataFrame(rows, schema).repartition(3)).collect()))
    assert kept == sorted([*clean, min(first, linked)])
    rows = [(7, first), (7, linked), (None, linked), (8, first)]
    assert [tuple(r) for r in simhash.keep_first(spark.createDataFrame(rows, schema)).collect()] == [(7, min(first, linked))]
    # one contaminated row of a null and of a repeated id
    rows = [(None, clean[0]), (None, "x " + item), (None, clean[1]), (5, item + " y"), (5, clean[2]), (6, clean[3])]
    found = decontaminate.keep_clean(spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.text for r in found.collect()) == sorted(clean)


def test_quality(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 80) if i % 4 else " | ".join(WORDS) + " ### $$$" * 20) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(600)] + [(None, 1), (3, None), (900, 1)], "doc_id long, quality int")
    described = quality.describe(df)
    model = quality.fit(described, labels)
    found = quality.score(described, model).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all((r.doc_id % 4 > 0) == (r.predicted == 1) for r in held) and all(0 <= r.score <= 1 for r in found)
    assert quality.score(quality.describe(odd), model).count() == odd.count()
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns
    assert quality.score(quality.describe(none), model).count() == 0
    untaught = quality.fit(described, labels.limit(0))
    assert {r.score for r in quality.score(described, untaught).collect()} == {0.5}


def test_isotonic():
    p = quality.isotonic(np.array([10.0, 10, 0, 10, 10]), np.array([1.0, 5, 0, 3, 9]))
    assert (np.diff(p) >= 0).all() and p[1] == pytest.approx(p[3])


def test_language_model_tokens_in_arrow():
    """Words, tail classes and counts of a slice come from Arrow and are what Python's splitting gives, also in a slice with an offset."""
    given = [None, "", " \t", "A b\x0bÉa  b\n", "x\x1cy\x85z\xa0w é", "\x00 \U0001f600 it's 7. Z"]
    for column in (pa.array(given), pa.array(["q", *given]).slice(1)):
        t = language_model.tokenised(column)
        distinct = t.distinct.to_pylist()
        found = [(x or "").encode().lower().split() + [language_model.END] for x in given]
        assert [distinct[i] for i in t.at] == [w for d in found for w in d]
        assert np.diff(t.bounds).tolist() == [len(d) for d in found]
        v = language_model.Vocabulary({b"b": 0, language_model.END: 1}, np.array([2, 6]), 8, 2, None, None, 1)
        number = v.numbers(t.distinct)[t.at].tolist()
        assert number == [v.known.get(w, -1 - (language_model.HEAD + int(language_model._TAIL_OF[w[-1]]))) for d in found for w in d]


def test_language_model(spark, odd, none):
    rng = random.Random(5)
    rows = [(i, " ".join(w for _ in range(40) for w in rng.choice([("good", "morning"), ("dear", "friend"), ("cold", "rain")]))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = language_model.score_documents(df).collect()
    held = [r for r in found if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in held)
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)  # pairs are learned
    counts = language_model.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*t.split(), "\n"])
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in found[:50]:
        own = [*texts[r.doc_id].split(), "\n"]
        assert r.train_tokens == n and r.n_tokens == r.n_known == len(own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    got = {r.doc_id: r for r in language_model.score_documents(odd).collect()}
    assert got[1].n_tokens == 1 and got[None].held_out and len(language_model.score_documents(odd).collect()) == odd.count()
    assert language_model.score_documents(none).count() == 0


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(i, "a b c a b") for i in range(20)], "text_id long, text string").select("text")
    counted = language_model.count_tokens(df).cache()
    v = language_model.summarise(counted)
    model = language_model.train(df, v)
    z = model.log_normalisers()
    k = np.arange(len(model.bias))
    for one, two in ((0, 1), (v.end, v.end)):
        assert np.exp(model.log_probability(k, np.full(len(k), one), np.full(len(k), two), z)).sum() == pytest.approx(1, abs=1e-4)


def test_url_filter(spark):
    urls = [None, "", "no-scheme.com/x", "http://www.EXAMPLE.com/en/1?x=/fr/", "http://a.b.example.com/en/", "https://x.net/es/?q", "http://notexample.com/en/", "http://y.net", "http://casino-win.example.org/fr/1", "ftp://u@h:80/p#f", "http://é.org/中\n/x", "http://a.org?b://c"]
    df = spark.createDataFrame([*enumerate(urls), (3, urls[3])], "page_id int, url string").withColumn("score0", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert (got[0].host, got[0].path, got[0].rule) == ("", "", None) and got[2].host == ""
    assert (got[3].rule, got[3].verdict) == ("www.example.com/en/", "allow") and (got[4].rule, got[4].verdict) == ("example.com/en/", "block")
    assert (got[5].rule, got[5].verdict) == ("net/es/", "block") and got[6].rule == "com/" and got[7].rule is None and got[8].verdict == "block"
    assert (got[9].host, got[9].path) == ("u@h:80", "/p") and got[11].host == "a.org"
    w, b = url_filter.default_model()
    for r in got.values():
        host, path = url_filter.split_url(urls[r.page_id])
        ids = url_filter.gram_ids(url_filter.grams_text(host, path))
        odds = sum(w[i] for i in ids) / max(1, len(ids)) ** 0.5 + b
        assert (r.host, r.path) == (host, path) and r.score == pytest.approx(1 / (1 + math.exp(-odds)))
    assert url_filter.judge(df.limit(0)).count() == 0
    right = sum((url_filter.judge is not None) and ((sum(w[i] for i in url_filter.gram_ids(url_filter.grams_text(*url_filter.split_url(u)))) / 5 + b > 0) == bool(y)) for u, y in url_filter.labelled_urls())
    assert right > 0.95 * len(url_filter.labelled_urls())


def test_url_labels_do_not_hold_the_given_hosts(spark, sf_dir):
    names = lambda urls: {p for u in urls for p in url_filter.split_url(u)[0].split(".")}
    shared = set(url_filter.PREFIXES) | set(url_filter.DOMAINS) | {"www", "blog", "m", "example", "com", "net", "org", "news", "shop", "en"}
    trained = names(u for u, _ in url_filter.labelled_urls()) - shared
    given = names(r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect() if r.url) - shared
    assert not trained & given and not [x for x in trained if x.startswith(("thth", "tion"))]
    held = {url_filter.split_url(u)[0] for u, _ in url_filter.labelled_urls(held=True)}
    assert held and not held & {url_filter.split_url(u)[0] for u, _ in url_filter.labelled_urls()}
    unwanted, wanted = url_filter.held_out_shares()
    assert unwanted > 0.8 and wanted > 0.95


def test_media_index_of_many_tracks_and_fragments(spark):
    data = media.store(bytes(128))
    boxes = {p: (a, b) for p, a, b in media.walk(data)}
    a, b = boxes[(b"moov",)]
    ta, tb = boxes[(b"moov", b"trak")]
    second = data[ta - 8 : tb].replace(b"raw ", b"sowt")
    # the second track comes last in moov, so the payload that both share moves by its length
    moov = media.box(b"moov", data[a:b], second)
    shift = len(second)
    at = int.from_bytes(data[boxes[(b"moov", b"trak", b"mdia", b"minf", b"stbl", b"co64")][0] + 8 :][:8], "big")
    two = (data[: a - 8] + moov + data[b:]).replace(at.to_bytes(8, "big"), (at + shift).to_bytes(8, "big"))
    fragmented = data + media.box(b"moof", media.box(b"traf"))
    rows = spark.createDataFrame([(1, bytearray(two)), (2, bytearray(fragmented))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.index(rows).collect()}
    assert got[1].error is None and [t.codec for t in got[1].tracks] == ["raw ", "sowt"] and got[1].codec == "raw "
    assert all(t.n_samples == 2 and t.keyframes[0].offset == at + shift for t in got[1].tracks)
    assert "fragmented" in got[2].error and got[2].tracks is None
