"""The ten operators against brute force, and their defined results for awkward rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from argusframe.llm import ann, bpe, components, decontam, linededup, quality, sharding, simhash, suffixdedup, toxicity, training, trie, urlfilter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp int, tie string, bucket int"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.tokenizer_json(bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)


def words(rng, n):
    return " ".join(rng.choice(["the", "erhe", "tion", "anded", "Über", "été", "shin", "oned", "wh", "reha"]) + str(rng.randint(0, 400)) for _ in range(n))


def awkward(rng=None):
    """Rows with nulls, empty and very long texts, copies, near copies, repeated rows and repeated ids."""
    rng = rng or random.Random(8)
    base = words(rng, 80)
    passage = words(rng, 60)
    texts = [base, base, base.replace("the", "tho", 1), None, "", "   \n\t", "x", words(rng, 30) + " " + passage + " " + words(rng, 20), passage + "\n" + words(rng, 40), "ab" * 300, words(rng, 20_000), "line one of many\nline two of many\nother " + words(rng, 9), "first\nline one of many\nline two of many\nend"]
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1, "t", 2) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[3], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (2, "another text with the same id", "de", "s", 5, "c", 0, "t", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1: byte-level BPE


def test_bpe_as_the_library_would(spark, docs, reference):
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=True)
    assert sorted((r.doc_id is None, r.doc_id, r.ids) for r in got.collect() if r.doc_id is not None) == sorted((False, r[0], reference.encode_ordinary(r[1] or "")) for r in awkward() if r[0] is not None)
    back = bpe.decode(got, RANKS).collect()
    assert collections.Counter((r.doc_id, bytes(r.decoded)) for r in back) == collections.Counter((r[0], (r[1] or "").encode()) for r in awkward())


def test_bpe_digests(docs, none, reference):
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_chars_covered) for r in bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect())
    want = collections.Counter()
    for r in awkward():
        ids, raw = reference.encode_ordinary(r[1] or ""), (r[1] or "").encode()
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), len(r[1] or "")] += 1
    assert got == want
    assert bpe.round_trip_digests(none, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("pattern", [r".{5}|.", r"\w+ \w+|\w+|\W+", r"[^ ]+| +"])
def test_bpe_by_other_patterns(pattern):
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    codec = bpe.Codec(bpe.tokenizer_json(bpe.read_ranks(RANKS)), pattern)
    text = "some words, and more words with  spaces"
    assert np.frombuffer(next(codec.encode([text])), "<u4").tolist() == own.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x85 　'sdtaelvm019½३éßǅ日本😀!?.-"), st.characters(exclude_categories=["Cs"]))))
def test_bpe_of_any_text(codec, reference, text):
    ids = np.frombuffer(next(codec.encode([text], by_words=True)), "<u4")
    assert ids.tolist() == np.frombuffer(next(codec.encode([text])), "<u4").tolist()
    assert ids.tolist() == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()
    first, last = bpe.character_offsets(text.encode(), codec.ends(ids))
    # a token covers every character that it holds a part of, so neighbours share a split one
    assert all(0 <= a < b <= len(text) for a, b in zip(first, last, strict=True)) and (not len(ids) or (first[0] == 0 and last[-1] == len(text)))


# 2: decontamination


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def test_leaks_and_new_values(spark, none):
    question = "A train leaves Paris at 9 with 120 people and travels 300 km before it stops near Lyon where 45 people leave the train."
    changed = question.replace("Paris", "Madrid").replace("Lyon", "Toledo").replace("300", "512").replace("120", "77")
    mixed = "Anna gave Bert 5 apples and then Bert gave Anna 3 apples while Anna and Bert walked 4 km home."
    torn = mixed.replace("then Bert", "then Cleo")
    rows = [(0, "before that " + question + " and after"), (1, "Then: " + changed), (2, "something else entirely, without any of those words in such an order at all"), (3, None), (4, ""), (5, torn), (6, "x " + mixed.replace("Anna", "Cleo").replace("Bert", "Dora").replace("5", "8"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = items(spark, question, None, "", "too short", mixed)
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.leaks(docs, bench).collect()}
    assert got[0, 0] == "verbatim" and got[1, 0] == "reparameterised" and got[6, 4] == "reparameterised"
    assert {d for d, _ in got} == {0, 1, 6}
    assert {r.doc_id for r in decontam.clean_rows(docs, bench).collect()} == {2, 3, 4, 5}
    assert decontam.leaks(docs, bench.where("false")).count() == 0 and decontam.clean_rows(docs, bench.where("false")).count() == 7
    assert decontam.leaks(none, bench).count() == 0


def test_leaks_against_plain_search(spark):
    rng = random.Random(3)
    bench = [words(rng, rng.randint(20, 40)) for _ in range(30)]
    rows = [(i, words(rng, 50) + (" " + rng.choice(bench) + " " if rng.random() < 0.4 else " ") + words(rng, 30)) for i in range(200)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), items(spark, *bench)).collect()}
    assert got == {(i, k) for i, t in rows for k, b in enumerate(bench) if b in t}


def leaked(spark, texts, bench):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {(r.doc_id, r.item_id): (r.kind, r.changed_slots) for r in decontam.leaks(df, items(spark, *bench)).collect()}


def test_changed_names_that_open_short_sentences(spark):
    anna = "Anna has 5 apples. Anna gives 2 to Bert. Then Bert eats 1 of them. How many do Anna and Bert have?"
    other = "Mary Ann has 8 apples. Mary Ann gives 3 to Carlos. Then Carlos eats 2 of them. How many do Mary Ann and Carlos have?"
    merged = other.replace("Carlos", "Mary Ann")
    got = leaked(spark, ["Quiz: " + other + " Think.", "so " + anna, "Quiz: " + merged], [anna])
    assert got[0, 0][0] == "reparameterised" and got[1, 0] == ("verbatim", 0) and (2, 0) not in got


def test_changed_arithmetic(spark):
    bench = ["Compute 12 + 7 * 3 - 5 / 2 + 9 - 4 = ?", "Evaluate 12*35+4/7-2*8=?", "3 5 7 9 11 13 15 17 19 21 23 25 27 29", "How far is 5 km plus 300 m and then 2 km more for Anna on day 3?"]
    texts = [
        "Now compute 90 + 8 * 2 - 11 / 6 + 1 - 3 = ?", "please evaluate 1 * 2 + 3 / 4 - 5 * 6 =?", "evaluate 1*2+3/4-5*6=?", "list: 3 5 7 9 11 13 15 17 19 21 23 25 27 29 and on", "list: 4 6 8 10 12 14 16 18 20 22 24 26 28 30 and on",
        "how far is 7km plus 450 m and then 9 km more for Carla on day 8?", "compute nothing of that sort here",
    ]
    got = leaked(spark, texts, bench)
    assert set(got) == {(0, 0), (1, 1), (2, 1), (3, 2), (5, 3)} and got[3, 2] == ("verbatim", 0) and got[0, 0][1] > 0


def test_a_changed_word_does_not_break_a_leak(spark):
    rng = random.Random(5)
    item = words(rng, 30).lower().split(" ")
    edited = item[:12] + ["inserted", "words"] + item[13:]
    got = leaked(spark, [" ".join(edited), " ".join(item[:12] + [f"w{i}" for i in range(9)] + item[12:20])], [" ".join(item)])
    assert set(got) == {(0, 0)}


def plain_leak(t, u):
    """Longest consistent chain of (kind, word) tokens t and u by trying every chain of common runs."""
    n = min(decontam.WINDOW, len(u))
    if n < decontam.LEAST:
        return 0
    key = lambda w: tuple(x[1] for x in w) if sum(not x[0] for x in w) < min(decontam.LITERAL, n) else tuple(x[0] or x[1] for x in w)
    rich = lambda w: sum(not x[0] for x in w) >= min(decontam.LITERAL, n)
    hits = {(p, q) for p in range(len(t) - n + 1) for q in range(len(u) - n + 1) if rich(t[p : p + n]) == rich(u[q : q + n]) and key(t[p : p + n]) == key(u[q : q + n])}
    covered = collections.defaultdict(set)
    for p, q in hits:
        covered[p - q] |= set(range(p, p + n))
    best = 0

    def stretch(places):
        return max((z - a for a in range(len(places)) for z in range(a + 1, len(places) + 1) if one_to_one(places[a:z])), default=0)

    def one_to_one(places):
        pairs = {(u[q], t[p]) for p, q in places if u[q][0]}
        return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})

    for shift, ps in covered.items():
        run = []
        for p in sorted(ps):
            if run and p != run[-1][0] + 1:
                run = []
            run.append((p, p - shift))
            best = max(best, stretch(run))
    return best


def test_runs_against_plain_search():
    """Without gaps to chain over, the longest stretch is that of the plain search."""
    rng = random.Random(7)
    sample = ["5", "6", "7", "Anna", "Bert", "walks", "home", "with", "a", "dog", "+", "3km"]
    known = decontam.Templates()

    def tokens(text):
        t, v = known.template(known.numbers(text))
        return t, v

    checked = 0
    for _ in range(250):
        item = " , ".join(rng.choice(sample) for _ in range(rng.randint(3, 18)))
        near = [w if rng.random() < 0.9 else rng.choice(sample) for w in item.split(" , ")]
        doc = " , ".join([rng.choice(sample) for _ in range(rng.randint(0, 6))] + near + [rng.choice(sample) for _ in range(rng.randint(0, 6))])
        (t, v), (u, w) = tokens(doc), tokens(item)
        n = min(decontam.WINDOW, len(u))
        if n < decontam.LEAST:
            continue
        a, b = decontam.windows(t, v, n), decontam.windows(u, w, n)
        its, own = decontam._slots(t, v, np.arange(len(a)), n), decontam._slots(u, w, np.arange(len(b)), n)
        found = [(p, q, n, its[p].tolist(), own[q].tolist()) for p in range(len(a)) for q in range(len(b)) if a[p] == b[q]]
        alone = [f for f in found if len({(g[0] - g[1]) for g in found}) == 1]
        kinds = lambda t, v: [(int(k) if k <= decontam.QUANTITY else 0, int(x) & ~3 if k <= decontam.QUANTITY else int(k)) for k, x in zip(t, v, strict=True)]
        want = plain_leak(kinds(t, v), kinds(u, w))
        if len(alone) != len(found) or len(list(decontam.chains([f[:3] for f in found]))) > 1:
            continue
        one = list(decontam.chains([f[:3] for f in found]))
        if one and len(one[0]) > 1:
            continue
        got = decontam.longest_leak(len(u), found)
        assert (got[0] if got else 0) == (want if want >= decontam._needed(len(u)) else 0)
        checked += 1
    assert checked > 60


def test_leaks_of_awkward_rows(spark, docs, none):
    passage = next(t for i, t, *_ in awkward() if i == 8).split("\n")[0]
    bench = spark.createDataFrame([(1, passage, "x"), (2, passage, "x"), (1, passage, "x"), (3, None, "x"), (4, "", "x"), (None, "a text that stands nowhere at all in any of these rows", "x"), (5, words(random.Random(77), 9000), "x")], "item_id bigint, text string, id string")
    got = decontam.leaks(docs, bench)
    assert sorted((r.doc_id, r.item_id, r.kind) for r in got.collect()) == [(7, 1, "verbatim"), (7, 2, "verbatim"), (8, 1, "verbatim"), (8, 2, "verbatim")]
    clean = decontam.clean_rows(docs, bench)
    assert clean.columns == docs.columns
    left = collections.Counter(tuple(r) for r in clean.collect())
    assert left == collections.Counter(r for r in awkward() if r[0] not in (7, 8))
    assert decontam.leaks(none, bench).count() == 0 and decontam.clean_rows(docs, bench.where("false")).count() == len(awkward())


def test_a_window_of_many_documents(spark):
    """Every document holds the item; nothing is capped."""
    item = words(random.Random(15), 25)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{item} "), F.col("id").cast("string")).alias("text"))
    assert decontam.leaks(df, items(spark, item, item)).count() == 6000
    assert decontam.clean_rows(df, items(spark, item)).count() == 0


# 3: sharding


def test_shards(spark, docs, none, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, words(rng, rng.randint(1, 60))) for i in range(800)], "doc_id bigint, text string")
    got = sharding.shard_documents(df, 8, map_path=str(tmp_path / "map")).collect()
    sums, places = collections.Counter(), collections.defaultdict(list)
    text = {r.doc_id: r.text for r in df.collect()}
    for r in got:
        sums[r.shard] += r.size
        places[r.shard].append(r.slot)
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
    assert len(sums) == 8 and max(sums.values()) < 1.02 * min(sums.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(got) == 800
    v1, v2 = (sharding.stored_map(spark, str(tmp_path / "map"), k) for k in (1, 2))
    moved = v1.alias("a").join(v2.alias("b"), "vslot").where("a.shard <> b.shard").count()
    assert v2.count() == sharding.SLOTS and moved < 800
    with pytest.raises(Exception):
        sharding.store_map(v2, str(tmp_path / "map"))
    more = sharding.grown(v2, 8)
    change = more.alias("a").join(v2.alias("b"), "vslot").where("a.shard <> b.shard").select("a.shard").distinct().collect()
    assert [r.shard for r in change] == [8]


def test_shards_of_awkward_rows(docs, none):
    got = sharding.shard_documents(docs, 8).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in awkward())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(none, 8).count() == 0


def test_shards_of_hot_groups(spark):
    """A third of the rows with one text, a third with a null id: sizes stay near equal. Equal records stand side by side."""
    rows = [(i, "the same text") for i in range(1500)] + [(None, f"text number {i:04d}") for i in range(1500)] + [(9000, "again")] * 40
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    sums = collections.Counter()
    for r in got:
        sums[r.shard] += r.size
    assert len(got) == 3040 and len(sums) == 8 and max(sums.values()) < 1.05 * min(sums.values())
    own = sorted((r.shard, r.slot) for r in got if r.doc_id == 9000)
    assert own == [(own[0][0], own[0][1] + k) for k in range(40)]


# 4 and 8: classifiers


def labelled(spark, n=700):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        t = words(rng, rng.randint(20, 80))
        if toxic:
            w = t.split(" ")
            w.insert(rng.randrange(len(w)), rng.choice(["vilest", "wretch"]))
            t = " ".join(w)
        if not good:
            t = t.upper().replace(" ", "!! ")
        rows.append((i, t, rng.choice(["en", "de"])))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def accuracy(rows, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_quality(spark, docs, none):
    d, lab = labelled(spark)
    rows = quality.judge(d, lab, 0.3).collect()
    assert accuracy(rows, lab, "quality") > 0.97 and all(0 <= r.score <= 1 for r in rows)
    model = quality.train(d, lab)
    assert quality.kept_rows(docs, model).columns == docs.columns
    assert quality.scored(docs, model).count() == len(awkward()) and quality.scored(none, model).count() == 0
    assert {r.score for r in quality.judge(docs, lab.where("false")).collect()} == {0.5}


def test_quality_learns_from_every_row(spark, monkeypatch):
    """The model of parts on the executors is that of all learnable rows at once, however many there are."""
    n = 7000
    docs = spark.createDataFrame([(i, f"Text {i % 13} of " + "words " * (i % 11) + ("!! " * (i % 5) if i % 2 else ", .")) for i in range(n)], "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, int(i % 2 == 0 or i % 3 == 0)) for i in range(n)], "doc_id bigint, quality int")
    monkeypatch.setattr(quality, "PART_ROWS", 2000)
    got = quality.train(docs, lab)
    own = [(r.text, r.quality) for r in docs.join(lab, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    y = np.array([q for _, q in own])
    want = quality.fit(np.array([quality.statistics(t) for t, _ in own]), y, y.mean())
    assert np.allclose(got.centre, want.centre) and np.allclose(got.factors, want.factors) and got.slope == pytest.approx(want.slope, rel=1e-4)


def test_toxicity(spark, docs, none):
    d, lab = labelled(spark)
    rows = toxicity.judge(d, lab).collect()
    assert accuracy(rows, lab, "toxic") > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.judge(docs, lab).count() == len(awkward()) and toxicity.judge(none, lab).count() == 0
    # the score sees the text alone
    other = toxicity.judge(d.withColumn("lang", F.lit("xx")), lab).collect()
    assert {r.doc_id: r.score for r in other} == {r.doc_id: r.score for r in rows}


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """Each learnable row counts and is learnt from, however many there are; parts and their order change nothing."""
    n = 5200
    docs = spark.createDataFrame([(i, f"plain words {i % 9} here" + (" vilest" if i % 4 == 0 else ""), ["en", "de", None][i % 3]) for i in range(n)], "doc_id bigint, text string, lang string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)] + [(3, 1), (None, 1)], "doc_id bigint, toxic int")
    used = {i for i in range(n) if zlib.crc32(str(i).encode()) % 5} - {3}
    counted, presence = [], toxicity.presence
    monkeypatch.setattr(toxicity, "presence", lambda packs: counted.append(presence(packs)) or counted[-1])
    monkeypatch.setattr(toxicity, "PART_ROWS", 500)
    rounds, learn_round = [], toxicity.learn_round
    monkeypatch.setattr(toxicity, "learn_round", lambda packs, *a: rounds.append(packs.count()) or learn_round(packs, *a))
    net = toxicity.train(docs, lab)
    seen, learn, spare = counted[0]
    assert learn.sum() + spare.sum() == len(used) and learn[1] + spare[1] == sum(i % 4 == 0 for i in used)
    assert seen[toxicity.parts_of(b"plain")[0]] == learn.sum() and seen[toxicity.parts_of(b"vilest")[0]] == learn[1]
    assert len(rounds) == 4 and min(rounds) > 5
    assert set(net.thresholds) == {"", "en", "de"}
    other = toxicity.train(docs.repartition(7), lab.repartition(3))
    assert np.array_equal(net.table, other.table) and np.array_equal(net.out, other.out) and net.thresholds == other.thresholds


def test_toxicity_thresholds_against_every_cut(spark):
    """The threshold of each language is the one with the best F1 among all cuts between scores."""
    rng = np.random.default_rng(8)
    net = small_network(rng)
    texts = [words(random.Random(i), 4) for i in range(300)]
    rows = spark.createDataFrame([(i, t, ["en", "de"][i % 2], int(rng.random() < 0.3)) for i, t in enumerate(texts)], "id bigint, text string, lang string, label int")
    packs = toxicity.packed(rows, 3)
    toxicity.calibrate(packs, net, False)
    known = toxicity.Lexicon()
    scores, rows = net.score([known.numbers(t) for t in texts], net.embeddings(known.parts)), rows.collect()
    for lang in ("", "en", "de"):
        own = [(scores[r.id], r.label) for r in rows if lang in ("", r.lang)]
        f1 = lambda cut: 2 * sum(y for s, y in own if s >= cut) / (sum(s >= cut for s, _ in own) + sum(y for _, y in own))  # noqa: E731, B023
        assert f1(net.thresholds[lang]) == pytest.approx(max(f1(s) for s, _ in own), abs=0.01)


def test_sample_of_labels(spark):
    """One row an id, whatever its copies; contradictions and held-out rows left out; bounded in rows and bytes."""
    docs = spark.createDataFrame([(i, f"text {i} " + "x" * (i % 7), "en") for i in range(300) for _ in range(1 + 40 * (i % 50 == 1))] + [(3, "another", "de"), (None, "n", None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(8, 1), (9, 1), (11, None), (None, 1), (13, 5)], "doc_id bigint, toxic int")
    rows, share = training.labelled_sample(docs, labels, "toxic", 10, 400, lang_col="lang")
    got = rows.collect()
    learnable = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5} - {8}
    assert len(got) == len({r.id for r in got}) and {r.id for r in got} <= learnable
    assert sum(r.label for r in got) == 10 and {r.id for r in got if not r.label} == {i for i in learnable if i % 2 == 0}
    assert share == pytest.approx(sum(i % 2 for i in learnable) / len(learnable))


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(training, "SAMPLE_BYTES", 100)
    docs = spark.createDataFrame([(i, "y" * 30) for i in range(40)] + [(50, "z" * 200)], "doc_id bigint, text string")
    rows, _ = training.labelled_sample(docs, docs.select("doc_id", F.lit(1).alias("quality")), "quality", 50, 50)
    assert sorted(len(r.text) for r in rows.collect()) == [30, 30, 30]


def small_network(rng):
    net = toxicity.Network(
        rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)), {w: rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS}, {w: rng.normal(size=toxicity.FILTERS) for w in toxicity.WIDTHS},
        rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)), 0.3,
    )
    net.table[0] = 0
    return net


def plain_logit(net, text):
    """A convolution word by word, the greatest response of each filter, and a logistic output."""
    x = [sum(net.table[b] for b in toxicity.parts_of(w)) for w in toxicity.words_of(text)] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    out = []
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            responses = [sum(x[i + s] @ net.filters[w][s][:, f] for s in range(w) if i + s < len(x)) for i in range(len(x))]
            out.append(max(0.0, max(responses) + net.bias[w][f]))
    return float(np.array(out) @ net.out + net.offset)


def test_convolution_against_a_plain_one():
    rng = np.random.default_rng(4)
    net, known = small_network(rng), toxicity.Lexicon()
    texts = ["", "one", "a few words here", "one two one two three", words(random.Random(1), 40)]
    docs = [known.numbers(t) for t in texts]
    assert np.allclose(net.logits(docs, net.embeddings(known.parts)), [plain_logit(net, t) for t in texts])


def test_gradients_against_differences():
    rng = np.random.default_rng(5)
    net, known = small_network(rng), toxicity.Lexicon()
    texts, y = ["one two three", "four", words(random.Random(2), 12), "two two four five"], np.array([1.0, 0, 1, 0])
    docs = [known.numbers(t) for t in texts]
    parts = np.array(known.parts)

    def loss():
        z = net.logits(docs, net.embeddings(parts))
        return float((np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)).mean())

    g = toxicity.gradients(net, docs, parts, y)
    at, rows = g["table"]
    checks = [(net.out, k, g["out"][k]) for k in range(0, 24, 5)] + [(net.bias[w], k, g["bias"][w][k]) for w in toxicity.WIDTHS for k in (0, 3)]
    checks += [(net.filters[w], i, g["filters"][w][i]) for w in toxicity.WIDTHS for i in ((0, 1, 2), (w - 1, 3, 4))]
    checks += [(net.table, (int(at[i]), 2), rows[i, 2]) for i in range(1, len(at), 7)]
    for value, i, want in checks:
        kept = value[i]
        value[i] = kept + 1e-6
        up = loss()
        value[i] = kept - 1e-6
        down = loss()
        value[i] = kept
        assert (up - down) / 2e-6 == pytest.approx(want, abs=1e-5)


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(6)
    k = len(quality.FEATURES)
    y = (rng.random(400) < 0.6).astype(int)
    x = rng.normal(size=(400, k)) * (1 + y[:, None]) + y[:, None]
    model = quality.fit(x, y, 0.6)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(s * (y == c).mean() for c, s in enumerate(covs))
    density = []
    for c, s in enumerate(covs):
        s = (1 - quality.TO_POOLED) * s + quality.TO_POOLED * pooled
        s = (1 - quality.TO_SPHERE) * s + quality.TO_SPHERE * np.trace(s) / k * np.eye(k)
        d = z - z[y == c].mean(0)
        density.append(np.array([-0.5 * v @ np.linalg.inv(s) @ v - 0.5 * np.linalg.slogdet(s)[1] for v in d]))
    assert np.allclose(model.difference(x), density[1] - density[0])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(model.slope * (density[1] - density[0]) + model.offset))))


# 5: nearest neighbours


def plain_nearest(rows, every, k):
    want = {}
    for q, v in rows:
        if q % every == 0:
            s = {}
            for i, x in rows:
                if i != q:
                    s[i] = max(s.get(i, -np.inf), float((np.array(v) * np.array(x)).sum()))
            want[q] = sorted(s, key=lambda i: (-s[i], i))[:k]
    return want


@pytest.mark.parametrize("block", [40, 20_000])
def test_nearest(spark, monkeypatch, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)) + 3 * rng.normal(size=(6, 16))[rng.integers(0, 6, 900)]
    x[7] = x[11]
    own = [(i, v.tolist()) for i, v in enumerate(x)]
    rows = own + [own[3], own[20]] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] * 8), (None, [1.0] * 16), (2080, [1.0] * 3), (2100, [])]
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "vec_id bigint, embedding array<double>, id int, part string, score double")
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    found = ann.search(df, 20, 20)
    got, want = found.collect(), plain_nearest(own, 20, 20)
    by = collections.defaultdict(dict)
    for r in got:
        by[r.query_id][r.rank] = (r.vec_id, r.score)
        assert np.isclose(r.score, (x[r.query_id] * x[r.vec_id]).sum(), atol=1e-12)
    assert set(by) == set(want) and all(sorted(v) == list(range(1, 21)) and len({a for a, _ in v.values()}) == 20 for v in by.values())
    share = np.mean([len({a for a, _ in by[q].values()} & set(want[q])) / 20 for q in want])
    assert share >= 0.9 and ann.recall(df, found) == pytest.approx(share)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_on_shipped_tables(spark, sf):
    """With the constants as they are; the router sends queries to some partitions, not to all."""
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    assert ann.recall(df, ann.search(df)) >= 0.9


def test_partitions_follow_the_table():
    x = np.random.default_rng(1).normal(size=(400, 8))
    assert ann.fit(x, 400, 5).w2.shape[1] == ann.LEAST_PARTS and ann.fit(x, 40_000, 5).w2.shape[1] == 20 and ann.fit(x, 10**9, 5).w2.shape[1] == 25


def test_nearest_of_ties(spark, monkeypatch):
    """All vectors alike, over several blocks: the smallest ids."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 30)
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, 50, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == {0, 50, 100, 150} and all(len(v) == 20 and v == sorted(v) for v in got.values())


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(5)], "vec_id bigint, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann.search(df).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert ann.search(df.where("false")).count() == 0 and ann.search(df.limit(1)).count() == 0


# 6: line dedup


def plain_line_dedup(rows, m, long_words=None):
    """(text, removed, maximal runs, longest) by comparing every suffix with every earlier one."""
    kept = {i: (t, [k for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]) for i, t in rows}
    lines = {i: [(t or "").split("\n")[k] for k in shown] for i, (t, shown) in kept.items()}
    places = [(i, k) for i in sorted(lines) for k in range(len(lines[i]))]
    out = {}
    for i, (t, shown) in kept.items():
        ends, cut = {}, set()
        for k in range(len(lines[i])):
            most = 0
            for j, at in places:
                if (j, at) >= (i, k):
                    break
                n = 0
                while k + n < len(lines[i]) and at + n < len(lines[j]) and lines[i][k + n] == lines[j][at + n]:
                    n += 1
                most = max(most, n)
            if most >= m:
                ends.setdefault(k + most, k)
                cut |= set(range(k, k + most))
            if most and long_words is not None and len(lines[i][k].split()) > long_words:
                cut.add(k)
        gone = {shown[k] for k in cut}
        text = t if not cut else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out[i] = (text, len(cut), len(ends), max((e - k for e, k in ends.items()), default=0))
    return out


def line_rows(df, *how, **named):
    return {r.doc_id: (r.text, r.removed_lines, r.n_runs, r.longest_run) for r in linededup.dedup(df, *how, **named).collect()}


@pytest.mark.parametrize("m", [1, 2, 3])
def test_line_dedup(spark, monkeypatch, m):
    monkeypatch.setattr(linededup, "PER_PARTITION", 30)  # groups reach over the ends of partitions
    rng = random.Random(m)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", "  "]) + str(rng.randint(0, 1)) * rng.randint(0, 1) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(70, "\n".join(["same"] * 23)), (71, "\n".join(["same"] * 9)), (72, "alone")]
    assert line_rows(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), m) == plain_line_dedup(rows, m)


def test_line_runs_have_exact_lengths(spark):
    run = [f"line {i}" for i in range(21)]
    rows = [(1, "\n".join(run)), (2, "\n".join(["new", *run[:19], "end"])), (3, "\n".join([*run[3:14], "x", "y", *run[12:20], "x", "y"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(linededup.levels(linededup.suffix_lines(df, 50))) == 5
    got = line_rows(df)
    assert got == plain_line_dedup(rows, 2, 50) and {i: x[2:] for i, x in got.items()} == {1: (0, 0), 2: (1, 19), 3: (3, 11)}


def test_line_dedup_of_awkward_rows(spark, docs, none):
    got = linededup.dedup(docs).collect()
    assert len(got) == len(awkward()) and {r.text for r in got if r.doc_id == 12} == {"first\nend"} and {r.text for r in got if r.doc_id == 3} == {None}
    assert [r.text for r in got if r.doc_id is None and r.text] == [awkward()[0][1]]
    assert linededup.dedup(none).count() == 0 and linededup.dedup(none).columns[: len(none.columns)] == none.columns
    named = docs.withColumnsRenamed({"tie": "argus_tie", "id": "spans", "doc_id": "doc", "bucket": "tie", "fp": "Spans_"})
    again = linededup.dedup(named, id_col="doc")
    assert again.columns == [*named.columns, "n_lines", "removed_lines", "n_runs", "longest_run"]
    assert collections.Counter((r.doc, r.text, r.argus_tie, r.spans) for r in again.collect()) == collections.Counter((r.doc_id, r.text, r.tie, r.id) for r in got)
    words_as_ids = linededup.dedup(docs.withColumn("doc_id", F.format_string("%04d", "doc_id")))
    assert collections.Counter(r.removed_lines for r in words_as_ids.where("doc_id <> 'null'").collect()) == collections.Counter(r.removed_lines for r in got if r.doc_id is not None)


def test_long_line_between_others(spark):
    rng = random.Random(6)
    long, short = words(rng, 51), words(rng, 50)
    rows = [(1, f"a1\n{long}\na2\n{short}"), (2, f"b1\n{long}\nb2\n{short}\nb3"), (3, long), (4, f"c1\n\n{long}\n{long}\nc2"), (5, short)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert line_rows(df, long_words=50) == plain_line_dedup(rows, 2, 50)
    assert {i: x[0] for i, x in line_rows(df).items()} == {1: rows[0][1], 2: f"b1\nb2\n{short}\nb3", 3: "", 4: "c1\n\nc2", 5: short}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df.withColumn("n_chars", F.length("text")), "").collect()} == {1: rows[0][1], 2: f"b1\nb2\n{short}\nb3", 4: "c1\n\nc2", 5: short}


# 7: urls


def pages(spark, *urls):
    return spark.createDataFrame([(i, *u) if isinstance(u, tuple) else (i, u, "") for i, u in enumerate(urls)], "page_id bigint, url string, html string")


def test_url_rules(spark):
    df = pages(spark, "https://A.Example.com/en/1?x#y", "http://example.com/en/70", None, "no scheme", "https://x.net/de/3", "https://www.example.net/de/88", "https://evilcom/en/1", "https://a.org:80/es/1", "https://o.org/es/1#t", "https://o.org?/es/")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got[0] == ("a.example.com", "/en/1", "com/en/", "block") and got[1][2:] == ("example.com/en/7", "allow") and got[2] == got[3] == ("", "", None, "allow")
    assert got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("example.net/de/8", "block") and got[6][2] is None and got[7][:3] == ("a.org:80", "/es/1", None) and got[8][2:] == ("org/es/", "block") and got[9][:3] == ("o.org", "", None)


def link(u):
    return f'<head><link href="{u}" rel="canonical"></head>'


def test_decisions_reach_aliases(spark):
    df = pages(spark, ("https://q.test/a", link("https://o.org/es/1")), ("http://www.q.test/a/", ""), ("https://q.test/b", link("https://o.org/es/2") + link("https://n.net/de/2")), ("https://q.test/c", '<META http-equiv=refresh content="0; url=https://q.test/a">'), ("https://q.test/d", ""))
    got = {r.page_id: (r.verdict, r.component) for r in urlfilter.judge(df).collect()}
    # nothing says that http://www.q.test/a/ is the same page
    assert {i: x[0] for i, x in got.items()} == {0: "block", 1: "allow", 2: "allow", 3: "block", 4: "allow"}
    assert got[0][1] == got[3][1] == "https://o.org/es/1" and got[1][1] == "http://www.q.test/a/"
    moved = spark.createDataFrame([("https://q.test/d", "https://o.org/es/9"), (None, "https://q.test/d"), ("https://q.test/d", None)], "src string, dst string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, moved).collect()}[4] == "block"
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, guess_aliases=True).collect()}[1] == "block"
    assert urlfilter.judge(df.where("false")).count() == 0


def plain_verdicts(rows):
    """By flooding verdicts over links until nothing changes."""
    import re

    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

    def own(u):
        if not u or "://" not in u:
            return None
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    edges = [(u, to) for _, u, html in rows if u and "://" in u for to in re.findall(r'href="([^"]+)" rel="canonical"', html or "")]
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = []
    for i, u, _ in rows:
        seen, todo = {u}, [u]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        said = {own(x) for x in seen}
        out.append((i, own(u) or ("allow" if "allow" in said else "block" if "block" in said else "allow")))
    return collections.Counter(out)


def test_urls_of_awkward_rows(spark):
    rng = random.Random(9)
    urls = [f"https://{rng.choice(['a.com', 'Example.com', 'b.net', 'example.net', 'c.org', 'd.test'])}/{rng.choice(['en', 'de', 'es', 'x'])}/{rng.randint(0, 12)}" for _ in range(150)]
    urls += [None, "", "no scheme", "https://", "https://long.org/es/" + "y" * 100_000, "https://long.test/" + "z" * 100_000]
    rows = [(i, u, link(rng.choice(urls[:150] + urls[-2:])) if rng.random() < 0.4 else None) for i, u in enumerate(urls)]
    rows += rows[:9] + [(None, "https://d.test/x/1", None), (None, None, None), (3, "https://c.org/es/1", "")]
    df = spark.createDataFrame([(*r, "u", 1, "c") for r in rows], "page_id bigint, url string, html string, id string, node int, component string")
    got = urlfilter.judge(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "component"]
    assert collections.Counter((r.page_id, r.verdict) for r in got.collect()) == plain_verdicts(rows)


def test_hot_alias(spark):
    df = spark.createDataFrame([(i, f"https://hot.test/x?{i}", link("https://hot.test/x")) for i in range(3000)] + [(9999, "https://hot.test/x", link("https://b.org/es/1"))], "page_id bigint, url string, html string")
    assert {r.verdict for r in urlfilter.judge(df).select("verdict").distinct().collect()} == {"block"}


# 9: SimHash


def plain_fingerprint(text, width):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(rows, width, budget):
    f = [plain_fingerprint(t, width) for _, t in rows]
    label = [i for i, _ in rows]
    while True:
        new = [min((label[j] for j in range(len(rows)) if bin(f[i] ^ f[j]).count("1") <= budget and label[j] is not None), default=None) for i in range(len(rows))]
        if new == label:
            return collections.Counter((rows[i][0], f"{f[i]:016x}", label[i]) for i in range(len(rows)))
        label = new


def test_simhash(docs, none):
    rows = [(r[0], r[1]) for r in awkward()]
    got = collections.Counter(tuple(r) for r in simhash.components(docs, 3, 2).collect())
    assert got == plain_components(rows, 3, 2)
    assert simhash.components(none).count() == 0


@pytest.mark.parametrize("bits,budget", [(8, 2), (16, 3), (64, 2)])
def test_trie_join(bits, budget):
    rng = np.random.default_rng(bits)
    a = np.unique(rng.integers(0, 1 << min(bits, 63), 150, dtype=np.uint64))
    a = np.unique(np.concatenate([a, a[:40] ^ np.uint64(5), a[:40] ^ np.uint64(1)]))
    got = {(i, j) for x, y, _ in trie.near_pairs(a, None, bits, budget) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    d = np.bitwise_count(a[:, None] ^ a[None])
    assert got == set(zip(*(x.tolist() for x in np.where(np.triu(d <= budget, 1))), strict=True))


def test_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PER_BLOCK", 20)
    rng = np.random.default_rng(3)
    v = np.unique(np.concatenate([rng.integers(0, 1 << 10, 150), (1 << 39) + rng.integers(0, 1 << 30, 50)]))
    df = spark.createDataFrame([(0, int(x)) for x in v], "t int, v bigint")
    links = simhash.trie_links(df, 40, 2)
    groups = {r.node: r.component for r in components.connected_components(links.select(F.col("v").alias("src"), F.col("w").alias("dst"))).collect()}
    d = np.bitwise_count(v[:, None] ^ v[None]) <= 2
    label = v.copy()
    while not (label == (new := np.array([label[d[i]].min() for i in range(len(v))]))).all():
        label = new
    assert {int(x): groups.get(int(x), int(x)) for x in v} == dict(zip(v.tolist(), label.tolist(), strict=True))


def test_dealt_rows_grow_as_the_values(spark, monkeypatch):
    """A table of 3 million values (6 GB of texts) is dealt as often a value as a small one; tables dealt one after the other give the same links."""
    assert simhash._dealt(3_000_000, 40, 3) == 8 * 3_000_000
    rng = np.random.default_rng(8)
    v = np.unique(np.concatenate([x := rng.integers(0, 1 << 40, 60), x ^ 9]))
    df = spark.createDataFrame([(t, int(x), None) for t in range(4) for x in v[t:]], "t int, v bigint, g bigint")
    whole = sorted(map(tuple, simhash.open_links(df, 40, 3).collect()))
    monkeypatch.setattr(simhash, "AT_ONCE", 1 << 11)
    parts = simhash._open_by_tables(df, 4, 40, 3)
    assert len(parts) == 2 and len(whole) > 200 and sorted(tuple(r) for p in parts for r in p.collect()) == whole


def test_open_links_against_every_pair(spark):
    """Links whose differing bits lie in either half or both, each once; none inside a group."""
    rng = np.random.default_rng(21)
    v = rng.integers(0, 1 << 40, 60)
    near = [v ^ sum(1 << int(k) for k in places) for places in ([0, 5, 19], [20, 30, 39], [1, 21, 39], [2, 3, 25], [17], [19, 20], [1, 2, 22, 23])]
    v = np.unique(np.concatenate([v, *near]))
    g = [None if x % 3 else int(x) % 5 for x in v]
    df = spark.createDataFrame([(t, int(x), k) for t in (0, 7) for x, k in zip(v, g, strict=True)], "t int, v bigint, g bigint")
    got = collections.Counter((r.t, *sorted((r.v, r.w))) for r in simhash.open_links(df, 40, 3).collect())
    i, j = np.where(np.triu(np.bitwise_count(v[:, None] ^ v[None]) <= 3, 1))
    want = [(int(v[x]), int(v[y])) for x, y in zip(i, j, strict=True) if g[x] is None or g[x] != g[y]]
    assert got == collections.Counter((t, *p) for t in (0, 7) for p in want) and len(want) > 300


def test_trie_visits_grow_as_the_values(monkeypatch):
    """Node pairs a value: searched from either half within half the budget they hardly grow with the table."""
    seen = []
    monkeypatch.setattr(trie.np, "searchsorted", lambda v, x, f=np.searchsorted: seen.append(len(x)) or f(v, x))
    visits = []
    for n in (1 << 12, 1 << 15):
        seen.clear()
        v = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n, dtype=np.uint64))
        assert not sum(1 for i, j, d in trie.near_pairs(v, None, 40, 3, (20, 1)) if not (np.bitwise_count((v[i] ^ v[j]) >> np.uint64(20)) <= 1).all())
        visits.append(sum(seen) / n)
    assert visits[1] < 1.5 * visits[0] and visits[1] < 100


def test_near_duplicates(spark, docs, none):
    rng = random.Random(12)
    rows = []
    for g in range(25):
        base = words(rng, 120).split(" ")
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 4):
            w = list(base)
            w[rng.randrange(40, 80)] = "changed"
            rows.append((g * 10 + k, " ".join(w)))
        rows.append((g * 10 + 5, words(rng, 60)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 10 if i % 10 < 4 else i for i, _ in rows}
    kept = simhash.one_of_each(docs)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert kept.columns == docs.columns and ids == [0, 3, 6, 7, 8, 9, 10, 11, 12] or ids == [0, 2, 3, 6, 7, 8, 9, 10, 11, 12]
    assert simhash.one_of_each(none).count() == 0


def plain_similarity(a, b, width=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicates_of_few_words(spark):
    """Exactly, against every pair: texts of one word to thirty, with a word added, dropped or changed at any place."""
    rng = random.Random(41)
    texts = []
    for n in [1, 2, 5, 6, 7, *range(8, 34)]:
        base = words(rng, n).lower().split(" ")
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            k = rng.choice([0, len(w) - 1, rng.randrange(len(w))])
            how = rng.randrange(3)
            w[k : k + (how > 0)] = [] if how == 2 else [f"new{rng.randint(0, 99)}"]
            texts.append(" ".join(w) or "none")
        texts.append("shared words that many texts begin with " + words(rng, 3))
    label = list(range(len(texts)))
    near = [(i, j) for i in label for j in range(i) if plain_similarity(texts[i], texts[j]) >= 0.8]
    for _ in label:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(label)) and len(near) > 15


def test_near_pairs_in_a_large_group(spark):
    """Any two texts share at most two of their twelve changed places: 0.73 to 0.76 alike, which fails the check. Planted pairs are 0.87 alike."""
    base = words(random.Random(31), 789).split(" ")
    lines = [[(5 * (13 * c + (m * c + b) % 13) + 4, f"new{m}x{b}x{c}") for c in range(12)] for m in range(13) for b in range(13)]

    def text(places):
        w = list(base)
        for at, new in places:
            w[at] = new
        return " ".join(w)

    rows = [(i, text(places)) for i, places in enumerate(lines) if i >= 60 or i % 2 == 0]
    rows += [(i + 1, text(lines[i][:5] + lines[i + 1][5:])) for i in range(0, 60, 2)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 2 if i < 60 else i for i, _ in rows}


# 10: suffix array


def plain_byte_dedup(rows, length=suffixdedup.LENGTH):
    seen, out = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        out[i] = (len(raw), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0, np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


def byte_rows(n=40):
    rng = random.Random(10)
    passages = [words(rng, 40) for _ in range(4)]
    rows = [(i, " ".join(rng.choice([words(rng, rng.randint(5, 40)), rng.choice(passages)[rng.randint(0, 60) :]]) for _ in range(rng.randint(1, 5)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "z" * 500), (n + 3, "ab" * 260), (n + 4, "z" * 101), (n + 5, words(rng, 9000)), (n + 6, "é" * 200), (n + 7, "é" * 75)]


def dedup_rows(spark, rows, kind="bigint"):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.dedup(df.repartition(5)).collect()}


def test_bytes(spark, none):
    assert dedup_rows(spark, byte_rows()) == plain_byte_dedup(byte_rows())
    assert suffixdedup.dedup(none).count() == 0


@pytest.mark.parametrize("chunk,per", [(3, 40), (50, 15)])
def test_bytes_of_hot_tokens(spark, monkeypatch, chunk, per):
    """Tokens over the ends of chunks and ranges."""
    monkeypatch.setattr(suffixdedup, "CHUNK", chunk)
    monkeypatch.setattr(suffixdedup, "PER_PARTITION", per)
    assert dedup_rows(spark, byte_rows(25)) == plain_byte_dedup(byte_rows(25))


def test_bytes_of_text_ids(spark):
    rows = [(f"{i:03d}" if i % 7 else f"{i:03d}é", t) for i, t in byte_rows(12)]
    assert dedup_rows(spark, rows, "string") == plain_byte_dedup(sorted(rows))


def test_ranges_of_suffixes():
    """As Python's order of tuples has it."""
    rng = np.random.default_rng(3)
    rows = [tuple(int(x) for x in rng.integers(-2, 3, 6)) for _ in range(400)]
    keys = sorted({tuple(int(x) for x in rng.integers(-2, 3, 6)) for _ in range(60)})
    import pyarrow as pa

    t = pa.table({c: pa.array([r[k] for r in rows]) for k, c in enumerate(suffixdedup._KEYS)})
    import bisect

    assert suffixdedup.ranges_of(t, keys).tolist() == [bisect.bisect_right(keys, r) for r in rows]


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_multikey_quicksort(n):
    words_ = np.random.default_rng(n).integers(0, 3, (n, 5), dtype=np.uint64)
    got = suffixdedup.multikey_quicksort(words_)
    assert sorted(got.tolist()) == list(range(n)) and words_[got].tolist() == sorted(words_.tolist())


def test_bytes_of_repeated_rows(docs):
    got = suffixdedup.dedup(docs).collect()
    assert len(got) == len(awkward())
    # a null id comes first, so of the base text's rows only that one keeps its bytes
    assert [r.n_removed for r in got if r.doc_id == 0] == [len(awkward()[0][1].encode())] * 2 and [r.n_removed for r in got if r.doc_id is None] == [0, 0]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (None, 3), (7, None)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}
