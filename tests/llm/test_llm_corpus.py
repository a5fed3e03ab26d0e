"""Spelling variants, token files and the Merkle manifest against brute force, and over odd and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import LOWER, ODD, SCHEMA, prose

from flightloom.llm import fingerprints, manifest, packing, shared, spelling, tokenfiles
from flightloom.llm.queries import tokenizer
from flightloom.llm.text import NOT_WHITE, Words, joined, stretches


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    names = {n: F.lit(1) for n in ("word", "n", "form", "root", "ids", "row", "tree", "place", "leaf", "now", "part", "start", "n_tokens", "path", "range", "copy")}
    return df.withColumns(names).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# -- spelling variants ------------------------------------------------------
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    """(word -> form, root, n, n_near, form_n) of (doc_id, text), pair by pair."""
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    by_size = collections.defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def made(found):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


def test_variants_equal_brute_force(spark, docs, odd, empty):
    sample = docs.where("doc_id < 60")
    assert made(spelling.variants(sample)) == spelled([(r.doc_id, r.text) for r in sample.collect()])
    # chains of three, ties, accents next to plain letters, letters of other alphabets as cuts
    counts = {"gardener": 2500, "gardner": 2500, "gardeners": 240, "gardeneers": 24, "gardeneersx": 2, "étéééééé": 30, "étéééééè": 3, "aaaaaaa": 90, "aaaaaaaa": 9}
    rows = [(i, f" {w}Ā{w} ß÷ " * (n // 2), None, None, 0) for i, (w, n) in enumerate(counts.items())]
    rows += [(None, "x" * 60_000 + " Aaaaaaaa", "en", "a", 0)] * 2 + ODD
    table = spark.createDataFrame(rows, SCHEMA)
    want = spelled([(r[0], r[1]) for r in rows])
    assert made(spelling.variants(table)) == want and any(v[0] for v in want.values())
    assert spelling.variants(empty).count() == 0
    assert made(spelling.variants(odd)) == spelled([(r[0], r[1]) for r in ODD])


def test_neighbourhoods_hold_every_reduced_form():
    def edits(form, symbols):
        out = {form}
        for i in range(len(form) + 1):
            for s in range(1, symbols + 1):
                out.add(form[:i] + (s,) + form[i:])
                if i < len(form):
                    out.add(form[:i] + (s,) + form[i + 1 :])
            if i < len(form):
                out.add(form[:i] + form[i + 1 :])
        return out

    words = ["gardener", "aaaaaaa", "été", "a"]
    forms = spelling.Forms(words, 3)
    got = collections.defaultdict(list)
    for word, key in forms.neighbourhoods():
        for w, k in zip(word.tolist(), key.tolist()):
            got[w].append(k)
    for i, w in enumerate(words):
        letters = tuple(int(x) for x in forms.letters[forms.first[i] : forms.first[i + 1]])
        want = edits(letters, 3)
        assert len(got[i]) == len(set(got[i])) == len(want)


def test_crc32_of_many_ranges():
    data = np.frombuffer(("abc" * 200 + "é").encode(), np.uint8)
    start, end = np.array([0, 5, 7, 0, 602]), np.array([3, 5, 9, 600, 602])
    before = np.array([zlib.crc32(p) for p in (b"1:", b"22:", b"", b":", b"-3:")], np.uint32)
    want = [zlib.crc32(p + data[a:b].tobytes()) for p, a, b in zip((b"1:", b"22:", b"", b":", b"-3:"), start, end)]
    assert spelling.crc32_of(data, start, end, before).tolist() == want


# -- token files ------------------------------------------------------------
def coded(rows, end):
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(tokenizer()), [], 0
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, docs, odd, empty):
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    got = tokenfiles.round_trip(docs, tokenizer()).collect()
    assert sorted(map(tuple, got)) == coded(rows, 2)
    got = sorted(map(tuple, tokenfiles.round_trip(odd, tokenizer()).collect()), key=lambda r: r[1])
    # rows of one id are equal here, and the row without an id comes first
    assert got == coded(sorted([(r[0], r[1]) for r in ODD], key=lambda r: (r[0] is not None, r[0] or 0)), 2)
    assert tokenfiles.round_trip(empty, tokenizer()).count() == 0


def test_long_texts_and_hot_ids_are_cut_into_shards(spark):
    rows = [(3, prose(1, 40_000, 9_000)), (None, "a b"), (None, "c"), (None, "a b"), (1, "<|EndOfText|> x<|endoftext|>y"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = shared.new_folder(spark, "token-test")
    blocks = tokenfiles.write(df, folder, tokenizer(), 2, shard=5000, file_ids=20_000)
    got = sorted(map(tuple, tokenfiles.read(blocks, folder).collect()), key=lambda r: r[1])
    want = coded(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), 2)
    assert [g for g in got if g[0]] == [w for w in want if w[0]] and sorted(g[2:] for g in got) == sorted(w[2:] for w in want)
    long = max(blocks.collect(), key=lambda r: r.ids)
    whole = tokenfiles.read_ids(folder, long.file, long.place, 0, long.ids)
    for a, b in ((0, 1), (4999, 5001), (12_345, 23_456), (long.ids - 1, long.ids + 5), (7, 7)):
        assert (tokenfiles.read_ids(folder, long.file, long.place, a, b) == whole[a:b]).all()


def test_grammars_give_back_any_ids():
    rng = np.random.default_rng(5)
    for ids in ([], [7], [3] * 1000, [1, 2] * 500 + [2] * 77, rng.integers(0, 9, 5000), rng.integers(0, 70_000, 3000), np.tile(rng.integers(0, 50, 40), 60)):
        ids = np.array(ids, np.uint32)
        shard = tokenfiles.Shard(tokenfiles.grammar(ids))
        assert (shard.ids() == ids).all() and shard.n == len(ids)
        for a, b in ((0, 3), (len(ids) // 3, len(ids) // 2), (max(len(ids) - 2, 0), len(ids))):
            assert (shard.ids(a, b) == ids[a:b]).all()
    assert len(tokenfiles.grammar(np.array([3] * 100_000, np.uint32))) < 2000


def test_word_coder_equals_the_tokenizer(docs):
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["<|EndOfText|>", "<|ENDOFTEXT|>x <|endoftext|>. A<|StartOfText|>b <|startoftext|>", "don't I'LL it's 're\"'s .'s ö's", "straße été ÿß ï÷ø ǅ İ ﬁ x́", "12,5€ ¿qué? a1b2", "<|x|> <|", " a b"]
    texts += [r.text or "" for r in docs.limit(80).collect()]
    coder, whole = packing.WordCoder(tokenizer(), remembered=3000), Tokenizer.from_file(tokenizer())
    data, offsets = joined(pa.array(texts))
    for _ in range(2):
        words = Words(data, offsets, 0, len(texts), hashed=False)
        ids, first = coder.encode(packing.split_marks(words.data, words))
        for i, text in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text[:40]


def test_stretches_cover_all_bytes_and_cut_no_word():
    import pyarrow as pa

    texts = ["a b " * 30, "", "x" * 300, "y z", " " * 200, "word " * 100]
    data, offsets = joined(pa.array(texts))
    parts = collections.defaultdict(bytes)
    for a, at in stretches(data, offsets, NOT_WHITE, 64):
        for i in range(len(at) - 1):
            piece = data[at[i] : at[i + 1]].tobytes()
            assert not parts[a + i] or parts[a + i][-1:] == b" "
            parts[a + i] += piece
    assert [parts[i].decode() for i in range(len(texts))] == texts


# -- Merkle manifest --------------------------------------------------------
def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def proved(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = collections.defaultdict(list)
    for r in rows:
        leaf = lambda t, r=r: H("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, t))))
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
        trees[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r.text), leaf(r.text.translate(LOWER) if changed else r.text)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {n: levels([x[2] for x in sorted(trees[n])]) for n in names}
    over, out = levels([built[n][-1][0] for n in names]), []
    for j, name in enumerate(names):
        for i, (has, doc_id, leaf, node) in enumerate(sorted(trees[name])):
            proof = ""
            for tree, k in ((built[name], i), (over, j)):
                for level in tree[:-1]:
                    group = level[k - k % 8 : k - k % 8 + 8]
                    proof += "".join(group[: k % 8] + group[k % 8 + 1 :])
                    node, k = H("".join([*group[: k % 8], node, *group[k % 8 + 1 :]])), k // 8
            out.append((doc_id if has else None, leaf, built[name][-1][0], over[-1][0], H(proof), node, node == over[-1][0]))
    return sorted(out, key=str)


def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


def test_manifest_equals_brute_force(spark, docs, odd, empty):
    for table, options in ((docs, {}), (docs, {"levels": 1}), (odd, {"levels": 1, "asking": 2})):
        got = sorted([tuple(r) for r in manifest.manifest(table, tampered(), **options).collect()], key=str)
        want = proved(table.collect())
        assert got == want and (table is odd or any(not r[-1] for r in got))
    assert manifest.manifest(empty, tampered()).count() == 0
    alone = docs.limit(1)
    assert sorted([tuple(r) for r in manifest.manifest(alone, tampered()).collect()], key=str) == proved(alone.collect())


def test_manifest_of_repeated_and_missing_ids(spark):
    rows = [(None if i % 3 == 0 else (i * i) % 40 - 20 if i % 3 == 1 else i << 40, f"Text {i % 7}", None if i % 4 == 0 else f"l{i % 3}", "s", 1) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted([tuple(r) for r in manifest.manifest(table, tampered(), levels=2, asking=16).collect()], key=str)
    assert got == proved([r for r in table.collect()])


def test_bitmap_ranks():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 3000, 32_768):
        count = np.zeros(manifest.RANGE, np.int64)
        count[rng.choice(manifest.RANGE, n, replace=False)] = 1
        count[rng.choice(manifest.RANGE, 5)] += 3
        bitmap = manifest.Bitmap(*manifest.Bitmap.parts(count))
        at = np.flatnonzero(count)
        assert (bitmap.rank(at) == np.concatenate([[0], np.cumsum(count)])[at]).all() and (bitmap.repeats(at) == (count[at] > 1)).all()
        assert (bitmap.all() == at).all()


# -- fingerprints, mended this round ----------------------------------------
def test_fingerprint_and_likeness_by_brute_force(spark):
    rows = [(i, prose(i // 2, 80, 30) + (" extra" if i % 2 else ""), "en", "a", 1) for i in range(24)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r for r in fingerprints.compare_edited(table).collect()}
    width = 16
    cut = lambda s: [s[i : i + width] for i in range(0, len(s), width)]
    for i in range(24):
        own, after = cut(found[i].fingerprint), cut(found[(i + 1) % 24].fingerprint)
        either = [(a, b) for a, b in zip(own, after) if int(a, 16) or int(b, 16)]
        assert len(own) == fingerprints.Scheme().subsets
        assert found[i].near_next == pytest.approx(sum(a == b for a, b in either) / len(either))
    # the values of terms in hash order, one subset after the other
    terms = fingerprints.lexicon(table, fingerprints.Scheme())
    single = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(table, terms).collect()}
    assert single == {i: found[i].fingerprint for i in found}
