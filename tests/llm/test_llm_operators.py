"""Each operator against brute force, and over tables with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightloom.llm import fingerprints, language, licenses, mixing, near, packing, perplexity, quality, repeats, topk
from flightloom.llm.queries import QUERIES, tokenizer
from flightloom.llm.text import NOT_WHITE, Words, joined, slices, word_hash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in rng.integers(0, vocabulary, n))


LONG = prose(99, 9000, 3000)
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "word", "en", "a", 4), (5, LONG, "fr", None, 9),
    (5, LONG, "fr", None, 9), (None, "no id here at all", None, "b", 1), (7, "Ünï ÇÖDÉ   x́ 😀 ﬁ!!", "fr", "a", 1), (8, "word", "en", "a", 4),
    (9, "1 2 3 ...", "en", "", 9), (10, prose(1, 300), "en", "a", 1), (11, prose(1, 300) + " tail", "en", "a", 1), (12, prose(2, 120), "de", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    # names that operators use for columns of their own
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({"score": F.lit("kept"), "size": F.lit(7), "rank": F.lit(None).cast("int"), "key": F.col("doc_id"), "start": F.lit(0)}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["", None, "A b\tb", "b", "é É x\x0bY", "  "]
    data, offsets = joined(pa.array(texts))
    for most in (1, 4, 1000):
        got = []
        for a, b in slices(offsets, most):
            w = Words(data, offsets, a, b)
            got += [w.hash[w.first[i] : w.first[i + 1]].tolist() for i in range(b - a)]
        assert got == [[word_hash(x, NOT_WHITE) for x in words_of(t)] for t in texts]


# 1


def test_code_lengths_are_those_of_the_tree_and_sum_to_one():
    text = b"abracadabra, abracad"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    keys = language.grams(data, offsets, 3)
    tree = language.Tree(np.sort(keys), np.ones(len(keys), np.int64), 3)
    counts = collections.defaultdict(collections.Counter)
    padded = b"\0\0\0" + text
    for i in range(3, len(padded)):
        for k in range(4):
            counts[padded[i - k : i]][padded[i]] += 1

    def share(context, byte):
        out, p = set(), 1.0
        for k in range(len(context), -1, -1):
            seen = {b: n for b, n in counts.get(context[len(context) - k :], {}).items() if b not in out}
            total = sum(seen.values()) + len(seen)
            if byte in seen:
                return p * seen[byte] / total
            if seen:
                p *= len(seen) / total
            out |= set(counts.get(context[len(context) - k :], {}))
        return p / (256 - len(out))

    for context in (b"abr", b"rab", b"xyz", b"\0\0\0", b"zza"):
        wanted = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        got = 2.0 ** -tree.bits(wanted)
        assert abs(got.sum() - 1) < 1e-9
        assert np.allclose(got, [share(context, b) for b in range(256)])


def test_language_of_held_out_documents(spark, docs, odd, empty):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = language.identify(docs, ~held_out).join(docs.select("doc_id", "lang"), "doc_id").where(held_out).collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, F.lit(True)).collect()}
    assert got[1] == got[2] == got[3] == got[9] == "und" and got[5] == "fr" and got[None] in ("en", "fr", "de")
    assert language.identify(empty, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language.identify(odd, F.lit(False)).collect()} == {"und"}


# 2


def brute_kneser_ney(train, texts):
    c = collections.Counter(w for x in train for w in x)
    pairs = collections.Counter(p for x in train for p in zip(["\0"] + x, x))
    n, v, types = sum(c.values()), len(c), len(pairs)
    follow, left = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (a, w), k in pairs.items():
        follow[a][0] += k
        follow[a][min(k, 3)] += 1
        left[w] += 1
    of = lambda counts: perplexity.discounts([sum(1 for k in counts if k == j) for j in (1, 2, 3, 4)])
    d, d1 = of(pairs.values()), of(left.values())
    rest = sum(d1[min(k, 3)] for k in left.values()) / types

    def p1(w):
        return max(left[w] - d1[min(left[w], 3)], 0) / types + rest / (v + 1)

    def p(a, w):
        if a not in follow:
            return p1(w)
        total, *ones = follow[a]
        k = pairs[a, w]
        return max(k - d[min(k, 3)], 0) / total + sum(x * y for x, y in zip(ones, d[1:])) / total * p1(w)

    return n, v, c, [sum(math.log10(p(a, w)) for a, w in zip(["\0"] + x, x)) for x in texts]


def test_perplexity_equals_the_plain_model(spark, docs, odd, empty):
    for table in (docs, odd):
        held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
        rows = table.select("doc_id", "text", held_out.alias("h")).collect()
        toks = [words_of(r.text) + ["\0end"] for r in rows]
        n, v, c, scores = brute_kneser_ney([t for t, r in zip(toks, rows) if not r.h], toks)
        got = perplexity.score(table.select("doc_id", "text"), perplexity.train(table.where(~held_out))).collect()
        want = sorted((len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6), round(s, 6)) for t, s in zip(toks, scores))
        assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    model = perplexity.train(odd)
    assert collections.Counter(r.score for r in perplexity.score(odd, model).collect()) == collections.Counter(r.score for r in perplexity.score(odd.select("doc_id", "text"), model).collect())
    assert "rank" in perplexity.score(odd, model).columns and perplexity.score(odd.select("text", "score"), model).columns[0] == "n_tokens"
    none = perplexity.train(empty)
    assert {(r.n_known, r.base_score, r.score) for r in perplexity.score(odd.select("doc_id", "text"), none).collect()} == {(0, 0.0, 0.0)}
    assert perplexity.score(empty.select("doc_id", "text"), none).count() == 0


# 3


def test_licence_phrases_at_all_places(spark, docs, odd, empty):
    odd_texts = ["CC-BY cc by/cc by", "all rights reserved. ALL RIGHTS\nRESERVED", "cc", "by cc", "the General Public   License", "Released under the MIT Licence", "Released under an MIT License",
                 "all all rights reserved reserved", "generalé public license", "cc é by"]
    texts = docs.select("text").union(spark.createDataFrame([(t,) for t in odd_texts], "text string")).union(odd.select("text"))
    texts = texts.withColumn("doc_id", F.monotonically_increasing_id()).withColumn("labels", F.lit(1))
    got = {r.doc_id: r for r in licenses.scan(texts).collect()}
    plain = {r.doc_id: r.text for r in texts.collect()}
    assert set(got) == set(plain)
    for i, text in plain.items():
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        at, labels = [], set()
        for label, phrase in (("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])):
            found = [k for k in range(len(w)) if w[k : k + len(phrase)] == phrase]
            at += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by_text = {plain[i]: got[i].labels for i in plain}
    assert by_text["Released under an MIT License"] == "mit" and by_text["Released under the MIT Licence"] == ""
    assert licenses.scan(empty.select("doc_id", "text")).count() == 0


def test_licence_labels_of_edited_notices_by_brute_force(spark):
    templates = licenses.BASE + licenses.NOTICES + licenses.PARAGRAPHS
    rng, every = np.random.default_rng(5), [t.text.split() for t in templates]
    spare = sorted({w for t in every for w in t}) + ["other", "words"]
    texts = ["no modification is permitted here"] * 40 + ["redistribution and use in source and binary forms with or without changes are allowed. no modification is permitted here"]
    for words in every:
        for share in (0, 0.1, 0.2, 0.25, 0.3):
            for _ in range(4):
                hit = rng.random(len(words)) < share
                edited = [spare[rng.integers(len(spare))] if h else w for w, h in zip(words, hit)]
                around = [[spare[k] for k in rng.integers(0, len(spare), n)] for n in rng.integers(0, 6, 2)]
                texts.append(" ".join([*around[0], *edited[int(rng.integers(0, 2)) :], *around[1]]))
    wanted = []
    for text in texts:
        w = re.findall("[0-9a-z]+", text)
        labels, best = set(), 0.0
        for t, words in zip(templates, every):
            key = t.key.split() or words
            k = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            for at in range(-len(words), len(w)):
                there = [0 <= at + j < len(w) and w[at + j] == x for j, x in enumerate(words)]
                if sum(there) / len(words) >= (1 if t.base else 0.75) and all(there[k : k + len(key)]):
                    labels, best = labels | {t.label}, max(best, sum(there) / len(words))
        wanted.append((",".join(sorted(labels)), round(best, 9)))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(table).collect()}
    assert [got[i] for i in range(len(texts))] == wanted and got[40][0] == "bsd"
    assert 0.2 < np.mean([x != "" for x, _ in wanted]) < 0.8  # the texts try both outcomes


# 4


def test_fingerprints_of_edited_texts(spark, docs, odd, empty):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fingerprints.compare_edited(docs, parts=7).collect()}
    for k, (i, text) in enumerate(rows):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + rows[(k + 1) % len(rows)][1][:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    near_edited, near_next = (np.mean([getattr(r, x) for r in got.values()]) for x in ("near_edited", "near_next"))
    assert near_edited > 5 * near_next and all(0 <= r.near_edited <= 1 for r in got.values())
    for parts in (1, 3, 100):
        rows = fingerprints.compare_edited(odd, parts=parts).collect()
        assert len(rows) == len(ODD) and {r.doc_id for r in rows} == {r[0] for r in ODD}
        assert len({r.fingerprint for r in rows if r.doc_id in (4, 8)}) == len({r.fingerprint for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert fingerprints.compare_edited(empty).count() == 0
    one = fingerprints.compare_edited(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# 5


def brute_groups(texts, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    rep, root, links = {}, {i: i for i in texts}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(texts):
        if sets[i]:
            rep.setdefault(sets[i], i)
    reps = sorted(rep.values())
    for k, i in enumerate(reps):
        for j in reps[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(rep[s]), rep[s], links[rep[s]]) if s else (i, i, 0) for i, s in sets.items()}


def test_jaccard_join_against_all_pairs(spark, odd, empty):
    base, texts = prose(5, 220).split(), {}
    rng = np.random.default_rng(3)
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, len(w), int(rng.integers(0, 9))):
            w[k] = f"x{int(rng.integers(0, 50))}"
        texts[i] = " ".join(w)
    texts |= {100 + i: prose(50 + i % 15, 40) for i in range(30)} | {200: "", 201: "", 202: "one two", 203: "ONE two"}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("key", F.lit(1))
    want = brute_groups(texts)
    for block in (8, 192):
        got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in near.join(table, block=block).collect()}
        assert got == want
    assert len({x[0] for x in want.values()}) < len(want) - 40
    rows = near.join(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted({str(r[0]) for r in ODD})
    by = {r.doc_id: r.class_id for r in rows}
    assert by[8] == by[4] == 4 and by[11] == by[10] == 10
    assert near.join(empty).count() == 0


def test_jaccard_join_of_rows_that_share_an_id(spark):
    text = {k: prose(600 + k, 120) for k in range(4)}
    rows = [(None, text[0]), (None, text[0] + " tail"), (None, text[0]), (None, text[1]), (None, ""), (None, None), (3, text[2]), (3, text[1] + " end"), (4, text[2] + " x"), (5, text[3]), (5, text[3])]
    got = collections.Counter((r.doc_id, r.class_id, r.copy_of, r.n_links, r.n_copies) for r in near.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == {
        (None, None, None, 1, 2): 2, (None, None, None, 1, 1): 1, (None, 3, None, 1, 1): 1, (3, 3, 3, 1, 1): 2, (4, 3, 4, 1, 1): 1,
        (None, None, None, 0, 1): 2, (5, 5, 5, 0, 1): 1,
    }


def test_band_counts_reach_the_recall():
    bands, rows = near.bands_for(0.8, 0.9995, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


# 6


def test_repeated_passages_against_all_windows(spark, odd, empty):
    shared = [prose(70 + k, 60 + 9 * k, 5000) for k in range(6)]
    texts = {i: prose(1000 + i, 80, 9000) for i in range(40)}
    for i in range(40):
        for k in {i % 6, (i * 7) % 5}:
            texts[i] += "\n" + shared[k] + " " + prose(3000 + 10 * i + k, 30, 9000)
    texts[50] = texts[3]
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    where = collections.defaultdict(list)
    split = {i: words_of(t) for i, t in texts.items()}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            where[tuple(split[i][k : k + 50])].append((i, k))
    again, later = collections.defaultdict(set), collections.defaultdict(set)
    for places in where.values():
        for i, k in places if len(places) > 1 else []:
            again[i] |= set(range(k, k + 50))
            later[i] |= set(range(k, k + 50)) if (i, k) != min(places) else set()
    got = {False: collections.defaultdict(set), True: collections.defaultdict(set)}
    found = repeats.passages(table)
    for r in found.collect():
        got[r.repeated][r.doc_id] |= set(range(r.start, r.stop))
    assert got[False] == again
    assert all(got[True][i] <= later[i] for i in texts)
    assert sum(map(len, got[True].values())) >= 0.97 * sum(map(len, later.values()))
    kept = {r.doc_id: words_of(r.text) for r in repeats.remove(table, found).collect()}
    for i in kept:
        assert kept[i] == [w for k, w in enumerate(split[i]) if k not in got[True][i]]
    assert 50 not in kept and set().union(*kept.values()) == set().union(*map(set, split.values()))
    odd_found = repeats.passages(odd)
    assert {r.doc_id for r in odd_found.collect()} == {10, 11}
    assert repeats.remove(odd, odd_found).count() == len(ODD) - 0 and repeats.remove(odd, odd_found).columns == odd.columns
    assert repeats.passages(empty).count() == 0


def test_repeated_passages_of_rows_that_share_an_id(spark):
    part = prose(500, 70, 9000)
    long, short, other = prose(501, 90, 9000) + " " + part, prose(502, 20, 9000), prose(503, 100, 9000)
    rows = [(1, part), (None, long), (None, short), (None, None), (2, short), (2, long), (3, other), (3, other + " " + part), (None, other), (None, other)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = repeats.passages(table).cache()
    copies = found.where("repeated and doc_id is null and n_words = 100")
    assert found.where("doc_id is null and not repeated").count() == 3 and copies.count() == 1
    kept = collections.Counter((r.doc_id, " ".join((r.text or "").split())) for r in repeats.remove(table, found).collect())
    assert kept[None, short] == kept[2, short] == kept[None, ""] == kept[None, other] == 1
    assert kept[None, long] == 1 and kept.total() == 5  # all else is a later copy


# 7


def test_gradient_and_held_out_quality(spark, odd, empty):
    shape = quality.Shape(width=4, filters=3, hidden=4, half_chunk=8)
    net = quality.Network(shape, 1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    texts, y, w = [b"some text of a few chunks here", b"", b"zz!!"], np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        offsets = np.cumsum([0, *map(len, texts)])
        p = net.score(np.frombuffer(b"".join(texts), np.uint8), offsets, net.tables())
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    grad = net.gradient(texts, y, w)
    for name, at in (("hidden", (1, 2)), ("out", (1,)), ("filters", (1, ord("e"), 0)), ("bias", (2,)), ("hidden_bias", (0,))):
        before = net.p[name][at]
        values = []
        for step in (1e-3, -1e-3):
            net.p[name][at] = before + step
            values.append(loss())
        net.p[name][at] = before
        assert abs((values[0] - values[1]) / 2e-3 - grad[name][at]) < 2e-3
    rows = [(i, (prose(i, 60) if i % 3 else "#$ ".join(prose(i, 60).split())), "en", "a", 1) for i in range(400)] + [(None, "x", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(5, 1), (6, None), (None, 1)], "doc_id long, quality int")
    learned = quality.train(docs, labels, F.col("doc_id") < 300)
    got = {r.doc_id: r.score for r in quality.score(docs, learned).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in range(300, 400)]) > 0.95
    kept = quality.score(odd, learned, keep_text=True)
    assert kept.count() == len(ODD) and all(0 <= r.score <= 1 for r in kept.collect()) and set(kept.columns) == set(odd.columns)
    assert quality.score(empty, learned).count() == 0
    assert quality.train(empty, labels, F.lit(True)).prior == 0.5


def test_quality_sample_takes_long_texts_and_bounds_repeats(spark):
    long = [(i, prose(i, 400), "en", "a", 1) for i in range(30)] + [(30, "short", "en", "a", 1)] * 50 + [(31, None, "en", "a", 1)]
    docs = spark.createDataFrame(long, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(32)], "doc_id long, quality int")
    texts, y, weight = quality.sample(docs, labels, F.lit(True), 20, 500)
    assert len(texts) == 31 and all(len(t) in (500, 5) for t in texts) and texts.count(b"short") == 1
    plain = {i: t.encode() for i, t, *_ in long if t}
    assert all(any(t in p for p in plain.values()) for t in texts) and sum(t == plain[i][:500] for i, t in enumerate(texts)) < 5
    few = quality.sample(docs, labels, F.lit(True), 7, 500)
    assert len(few[0]) == 14 and few[1].sum() == 7
    assert sorted(few[0]) == sorted(quality.sample(docs.repartition(5), labels, F.lit(True), 7, 500)[0])


def test_quality_score_is_the_same_alone_and_in_any_batch():
    net = quality.Network(quality.Shape(), 3)
    texts = [b"", b"short", b"", b"seven b", prose(1, 400).encode(), b"\xff" * 256, b"short", b"x" * 257, b"\xf0" * 40]

    def score(these):
        return net.score(np.frombuffer(b"".join(these), np.uint8), np.cumsum([0, *map(len, these)]), net.tables()).tolist()

    alone = [score([t])[0] for t in texts]
    assert score(texts) == alone and score(texts[::-1]) == alone[::-1]
    # a gradient does not see the neighbours either
    zero = np.zeros(1)
    for k, t in enumerate(texts[:-1]):
        one, two = net.gradient([t], zero, zero + 1), net.gradient([t, texts[k + 1]], np.zeros(2), np.array([2.0, 0.0]))
        assert all(np.allclose(one[p], two[p], atol=1e-6) for p in one)


# 8


def test_packing_holds_every_token_once(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer())
    for table in (docs, odd.unionByName(odd.where("doc_id = 7").withColumn("text", F.lit("<|endoftext|> a<|startoftext|>b it's 'll don't. x..' é.!"))  # special and odd words
                                        .withColumn("doc_id", F.lit(77).cast("long")))):
        ids = collections.defaultdict(list)
        for r in table.collect():
            ids[r.doc_id].append(np.array(coder.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4"))
        rows = packing.pack(table, tokenizer()).collect()
        assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
        for r in rows:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        by = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for pieces in by.values():
            assert sum(n for _, n in pieces) <= 2048
            assert [o for o, _ in sorted(pieces)] == [0, *np.cumsum([n for _, n in sorted(pieces)])[:-1]]
        assert len(by) <= 1.03 * sum(r.length for r in rows) / 2048 + 1
    assert packing.pack(empty, tokenizer()).count() == 0


@pytest.mark.parametrize("histogram", [{}, {8: 1}, {2048: 3}, {8: 100000, 1032: 7}, {8 * (k + 1): (k * 37) % 50 for k in range(256)}])
def test_plans_use_each_piece_once(histogram):
    left = dict(histogram)
    plan = packing.plan(histogram)
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 2048
        for s, n in pattern.items():
            left[s] -= n * times
    assert not any(left.values())
    used, least = sum(t for _, t in plan), sum(s * n for s, n in histogram.items()) / 2048
    assert used <= max(1.25 * least + 2, sum(n for s, n in histogram.items() if s > 1024))


# 9


def test_mixing_meets_its_targets(spark, odd, empty):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 90))), None, [None, "a", "b", "é", "tiny"][int(rng.choice(5, p=[0.3, 0.3, 0.19, 0.2, 0.01]))], 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight, target, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        unit = left / max(sum(weight[s] for s in order if s not in full), 1e-9)
        over = [s for s in order if s not in full and weight[s] * unit > 3 * size[s]]
        if not over:
            break
        full |= set(over)
    taken = collections.Counter()
    for r in got:
        target[r.source] = r.target
        want = 3.0 * size[r.source] if r.source in full else weight[r.source] * unit
        assert r.source_size == size[r.source] and abs(r.target - want) < 1e-6 * want and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for s in order:
        assert abs(taken[s] - target[s]) <= 90
    assert sorted((r.doc_id, r.copies) for r in mixing.mix(docs.repartition(5)).collect()) == sorted((r.doc_id, r.copies) for r in got)
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(empty).count() == 0


# 10


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(120)] + [(i, [0.5] * 6) for i in range(120, 140)]
    bad = [(140, None), (141, [1.0, None]), (142, [float("nan")] * 6), (143, [float("inf")] * 6), (None, [1.0] * 6), (150, []), (151, [2.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    vectors = topk.integers(table)
    got = collections.defaultdict(list)
    for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), block=30, query_block=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows + [(150, []), (151, [2.0])]}
    for q in (0, 50, 100, 150):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:5]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    few = vectors.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    none = vectors.where("vec_id < 0")
    assert topk.top_k(none, none).count() == 0


def test_registered():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 11)] == [1] * 10
