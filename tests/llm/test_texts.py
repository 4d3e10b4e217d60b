"""Near-duplicates, substrings, tokens, media, toxicity, quality: against brute force, round trips and held-out labels."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stripelore.llm import bpe, media, near_dedup, quality, registry, substring_dedup, toxicity
from stripelore.llm.common import Scratch
from stripelore.llm.components import components
from stripelore.llm.shingles import chunks, shingle_hashes, word_hashes

DOCS = "doc_id long, text string, source string"
BLANK = "[^\x20\x09-\x0d]+"


def words(text):
    return re.findall(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def by_brute_force(rows, k, percent=80):
    sets, parent = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@given(st.lists(st.text(alphabet="aB \t\n\x0bé\x00日", max_size=30), max_size=8), st.integers(1, 4))
def test_shingles(texts, k):
    column, got = pa.array(texts, pa.string()), []
    for _, raw, offsets in chunks(column, 20):
        got += shingle_hashes(*word_hashes(raw, offsets), k)
    assert [len(g) for g in got] == [len(shingles(t, k)) for t in texts]
    for (a, x), (b, y) in itertools.combinations(zip(texts, got, strict=True), 2):
        assert len(np.intersect1d(x, y)) == len(shingles(a, k) & shingles(b, k))


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}


def test_odd_sketch():
    rnd = np.random.default_rng(2)
    a = rnd.integers(0, 2**32, (200, near_dedup.SAMPLES), dtype=np.uint32)
    b = a.copy()
    b[rnd.random(a.shape) < 0.15] += 1
    x, y = near_dedup.odd_sketch(a), near_dedup.odd_sketch(b)
    apart = np.bitwise_count((x ^ y).view(np.uint64)).sum(1)
    n, k = near_dedup.SKETCH, near_dedup.SAMPLES
    estimate = 1 + n / (4 * k) * np.log(1 - 2 * apart / n)
    assert abs(estimate.mean() - 0.85) < 0.01 and estimate.std() < 0.03
    assert near_dedup.most_differing(0.8) == int(n / 2 * (1 - np.exp(-4 * k / n * 0.2)))


def test_near_duplicates_on_documents(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in registry.QUERIES["op3_minhash_near_dedup"](spark, SF).collect()}
    assert got == by_brute_force(rows, 2)


def test_near_duplicates_in_a_large_group(spark):
    """A chain of texts, each near to its neighbours, and many variants of one text, in buckets beyond SMALL."""
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(120)] = f"v{rnd.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{j}" for j in range(140)]
    rows += [(1000 + i, " ".join(chain[2 * i : 2 * i + 100])) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == by_brute_force(rows, 2)
    many = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, rows=2, bands=4)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in many.collect()} == got


def test_blocks_link_as_brute_force(spark, monkeypatch):
    """Variants about the threshold, of which most are apart, in buckets cut into many blocks; small sets among them."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rnd = random.Random(6)
    rows = []
    for i in range(150):
        w = [f"w{j}" for j in range(80)]
        for _ in range(rnd.randint(3, 6)):
            w[rnd.randrange(80)] = f"v{rnd.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join(["a b c d e f g h i j k l m".split(), "a b c d e f g h i j k l x".split(), "a b c d e f g h i j k y x".split()][i % 3][: 6 + i // 3])) for i in range(21)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    want = by_brute_force(rows, 2)
    assert got == want and 3 < len({c for _, c, _ in want.values()}) < 171


@given(st.lists(st.sets(st.integers(0, 9), min_size=1), min_size=2, max_size=9))
def test_forest(sets):
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2)]
    linked = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    got = near_dedup.forest([np.array(sorted(s)) for s in sets], np.arange(len(sets)), np.array(pairs), 80)
    assert set(got) <= set(linked) and len(got) < len(sets)

    def groups(edges):
        of = list(range(len(sets)))
        for i, j in edges:
            of = [of[i] if x == of[j] else x for x in of]
        return [of.index(x) for x in of]

    assert groups(got) == groups(linked)


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c", "s"), (2, "A b C", "s"), (3, None, "s"), (4, "", "s"), (5, " \t", "s"), (None, "a b c", "s"), (None, None, "s"), (6, "one", "s"), (7, "ONE", "s"), (2, "A b C", "s"), (8, "x " * 50000, "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("clash")).withColumn("sig", F.lit(1))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 2).collect())
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (0, 2, None, True), (0, 0, None, True), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True)])
    stay = near_dedup.keep_one_of_each(docs, 2)
    again = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (1, None, "z"), (1, "a", "y")], DOCS)
    assert [r.text for r in near_dedup.keep_one_of_each(again.repartition(3), 2).collect()] == [r.text for r in near_dedup.keep_one_of_each(again.coalesce(1), 2).collect()]
    assert stay.columns == docs.columns and sorted(r.doc_id or 0 for r in stay.collect()) == [0, 0, 1, 3, 4, 5, 6, 8]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_substrings(spark):
    passage = " ".join(f"Here word{k} is one and here word{k} is two." for k in range(6))
    rows = [(3, f"Start three. {passage} End three.", "s"), (2, f"Start two.\n{passage}\nEnd two.", "s"), (5, f"{passage} {passage}", "s"), (6, "Hello there. All well. Bye.", "s"), (7, "Hello there. All well. So long.", "s"),
            (8, None, "s"), (9, "", "s"), (None, f"{passage} Free. {passage}", "s"), (2, f"Start two.\n{passage}\nEnd two.", "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash"))
    out = substring_dedup.remove_repeated_spans(docs)
    assert out.columns == [*docs.columns, "n_sentences", "n_removed"]
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str)
    want = [(3, "Start three. End three."), (2, rows[1][1]), (5, ""), (6, rows[3][1]), (7, rows[4][1]), (8, None), (9, ""), (0, f"{passage} Free. "), (2, rows[1][1])]
    assert got == sorted(want, key=str)
    assert substring_dedup.remove_repeated_spans(docs.limit(0)).count() == 0
    short = [(1, "Yes. No. Oh. First ends", "s"), (2, "Well. Yes. No. Oh. Second", "s"), (3, "これは一。これは二。これは三。おわり", "s"), (4, "はじめ。これは一。これは二。これは三。", "s"), (5, "Yes. No. " * 50000, "s")]
    got = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.remove_repeated_spans(spark.createDataFrame(short, DOCS)).collect()}
    assert got == {1: (short[0][1], 0), 2: ("Well. Second", 3), 3: (short[2][1], 0), 4: ("はじめ。", 3), 5: ("Yes. No. ", 99998)}


@given(st.text(alphabet="ab.!? \n\t", max_size=60))
def test_sentences_are_the_text(text):
    assert "".join(substring_dedup.sentences(text)) == text


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers as p

    path = p.path("byte_bpe_multi_50k.tiktoken")
    words = bpe.read_ranks(path)
    return bpe.Tokenizer(words, p.PATTERN, bpe.PerfectHash(words))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(tokens):
    assert tokens.hashed.candidates(tokens.tokens).tolist() == list(range(len(tokens.tokens)))
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])
    assert bpe.PerfectHash([b"only"]).candidates([b"only"]).tolist() == [0]


@settings(max_examples=300)
@given(st.text(max_size=80))
def test_tokens_as_the_library(tokens, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = np.frombuffer(tokens.encode(text), "<u4")
    assert ids.tolist() == library.encode_ordinary(text)
    assert tokens.decode(ids) == text.encode()


def test_long_pieces(tokens, library):
    for text in ("ab" * 3000, "é" * 2001, "x" * 5000, " " * 999, "!?" * 700):
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_tokens_query(spark, duck, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.QUERIES["op6_byte_bpe"](spark, SF).collect()}
    for i, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert got[i] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_tokens_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "Hi  there", "s"), (2, "", "s")], DOCS).withColumn("row", F.lit("clash"))
    back = bpe.decode(bpe.encode(docs))
    assert back.columns == [*docs.columns, "ids", "decoded"]
    assert sorted(bytes(r.decoded) for r in back.collect()) == [b"", b"", b"", b"Hi  there"]
    assert bpe.encode_and_decode(docs.limit(0)).count() == 0 and bpe.encode_and_decode(docs).count() == 4


@settings(max_examples=60)
@given(st.integers(1, 9), st.integers(1, 7), st.sampled_from([1, 3]), st.randoms(use_true_random=False), st.booleans())
def test_png_round_trip(rows, width, channels, rnd, chosen):
    samples = np.array([rnd.randrange(256) for _ in range(rows * width * channels)], np.uint8).reshape(rows, width, channels)
    filters = np.array([rnd.randrange(5) for _ in range(rows)], np.uint8) if chosen else None
    assert (media.read_png(media.write_png(samples, filters=filters)) == samples).all()


def test_png_is_checked():
    png = media.write_png(np.zeros((2, 64, 3), np.uint8))
    for bad in (b"x" + png[1:], png[:-6], png[:45] + bytes([png[45] ^ 1]) + png[46:], png[:20]):
        with pytest.raises(media.MediaError):
            media.read_png(bad)


def test_cosine_hash():
    rnd = np.random.default_rng(1)
    image = np.kron(rnd.integers(0, 256, (8, 8, 1)), np.ones((12, 8, 1))).astype(np.uint8)
    noisy = np.clip(image.astype(int) + rnd.integers(-6, 7, image.shape), 0, 255).astype(np.uint8)
    other = np.kron(rnd.integers(0, 256, (8, 8, 1)), np.ones((12, 8, 1))).astype(np.uint8)
    apart = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(media.cosine_hash(a), media.cosine_hash(b), strict=True))
    assert apart(image, noisy) <= 6 < 15 < apart(image, other)


def test_media_query(spark, duck):
    got = {r.doc_id: r for r in registry.QUERIES["op8_media_columns"](spark, SF).collect()}
    for i, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        payload = media.pad(text.encode())
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    odd = spark.createDataFrame([(1, "x" * 3_000_000, "s")], DOCS)
    clash = media.to_media(odd).withColumn("payload", F.lit("clash")).withColumn("hash", F.lit(1)).withColumn("row", F.lit(2))
    back = media.read_media(clash)
    assert back.columns == ["doc_id", "n_bytes", "media", "row", "payload", "hash"] and bytes(back.first().payload) == media.pad(b"x" * 3_000_000)
    odd = spark.createDataFrame([(None, None, "s"), (1, "", "s"), (1, "", "s")], DOCS)
    rows = media.read_media(media.to_media(odd)).collect()
    assert [bytes(r.payload) for r in rows] == [b" " * 192] * 3 and media.to_media(odd.limit(0)).count() == 0


def plain_kernel(s, t, order, decay):
    total = 0.0
    for a in itertools.combinations(range(len(s)), order):
        for b in itertools.combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


@settings(max_examples=40)
@given(st.lists(st.text(alphabet="abcé", max_size=7), min_size=1, max_size=5), st.lists(st.text(alphabet="abcé", min_size=1, max_size=6), min_size=1, max_size=3), st.integers(2, 4))
def test_kernel(strings, landmarks, order):
    got = toxicity.subsequence_kernel(strings, landmarks, order, 0.7)
    want = [[plain_kernel(s, t, order, 0.7) for t in landmarks] for s in strings]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-6)


def made_up(n, seed=0):
    rnd = random.Random(seed)
    part = ["th", "er", "on", "an", "re", "ing", "le", "st", "ou", "ti"]
    bad = ["wretch", "gumbug", "flonk", "snivvel"]
    rows = []
    for i in range(n):
        w = ["".join(rnd.choices(part, k=rnd.randint(1, 4))) for _ in range(60)]
        toxic = rnd.random() < 0.3
        for _ in range(3 * toxic):
            w.insert(rnd.randrange(60), rnd.choice(bad) + rnd.choice(["", "s", "ing", "!!"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = made_up(500)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(None, None, "s"), (9000, "", "s"), (9001, "flonk " * 30000, "s"), (9002, "the other " * 20000 + "snivvel", "s")], DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(None, 1, 1), (9000, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == x for i, x in held) >= 0.97 * len(held)
    assert out[9001].predicted == 1 and out[9000].predicted == 0 and out[None].predicted == 0
    for text in ("you w-r-e-t-c-h", "such a f l o n k", "gum.bug", "snivvvel", "a wretxch"):
        assert model.probability(np.array([model.margin(text)]))[0] > model.probability(np.array([model.margin("the other thing")]))[0] + 0.2, text
    assert out[9002].predicted == 1 and model.probability(np.array([model.margin("such a wre tch")]))[0] >= 0.5
    clash = docs.withColumn("toxic", F.lit(0)).withColumn("__id", F.col("doc_id"))
    stay = toxicity.reject_toxic(clash, labels)
    assert stay.columns == clash.columns and stay.where("doc_id = 9002").count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none).agg(F.max("predicted")).first()[0] == 0 and toxicity.score(docs.limit(0), none).count() == 0


def test_toxicity_query_on_held_out_labels(spark):
    where = SF.replace("0.001", "0.1")
    got = {r.doc_id: r for r in registry.QUERIES["op9_toxicity"](spark, where).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, x) for i, x in labels.items() if i in got and got[i].held_out and x is not None]
    assert sum(p for p, x in held if x == 1) >= 0.85 * sum(x == 1 for _, x in held) and sum(p for p, x in held if x == 0) <= 0.08 * sum(x == 0 for _, x in held)


def test_common_subsequences():
    rnd = random.Random(3)

    def longest(s, t):
        row = [0] * (len(t) + 1)
        for c in s:
            row = [0, *itertools.accumulate(range(1, len(t) + 1), lambda left, j, row=row, c=c: row[j - 1] + 1 if t[j - 1] == c else max(row[j], left), initial=0)][1:]
        return row[-1]

    strings = ["".join(rnd.choices("abcdé日", k=rnd.randint(1, 12))) for _ in range(200)]
    marks = ["".join(rnd.choices("abcdé日", k=rnd.randint(1, n))) for n in (3, 9, 12, 40)]
    known = toxicity._Landmarks(marks)
    codes = toxicity._codes(strings)[0]
    got = list(known.common(np.ascontiguousarray(known.symbol[codes].T)))
    assert [[int(x) for x in row] for row in got] == [[longest(s, m) for s in strings] for m in marks]


def test_windows_across_spaces():
    known = toxicity._Landmarks(["^idiot", "^bad"])
    got = toxicity.across(["what an idi ot he is", "id iot", "i-d i.o t", "idiot", "an id", "iot", "no id xiot. ID\nIOT", "", "ba d"], known)
    assert got == [{"^idiot"}, {"^idiot"}, {"^idiot"}, set(), set(), set(), {"^idiot", "^idxiot"}, set(), set()]


class PlainKneserNey:
    """The model by its definition, with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        grams = [(quality.EDGE * (order - 1) + t)[i : i + order] for t in texts for i in range(len(t))]
        self.levels = []
        counts = dict(Counter(grams))
        for n in range(order, 0, -1):
            m = [sum(c == k for c in counts.values()) for k in range(1, 5)]
            y = m[0] / (m[0] + 2 * m[1]) if m[0] else 0.5
            d = [min(max(k - (k + 1) * y * (m[k] / m[k - 1] if m[k - 1] else 0.0), 0.0), k) for k in (1, 2, 3)]
            total, off = Counter(), Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                off[g[:-1]] += d[min(c, 3) - 1]
            self.levels.append((counts, d, total, off))
            if n == 1:
                self.first = 1 / (len(counts) + 1)
            counts = dict(Counter(g[1:] for g in counts))
        self.levels.reverse()

    def p(self, gram):
        if not gram:
            return self.first
        counts, d, total, off = self.levels[len(gram) - 1]
        lower, context, c = self.p(gram[1:]), gram[:-1], counts.get(gram, 0)
        if not total[context]:
            return lower
        return (c - d[min(c, 3) - 1] if c else 0.0) / total[context] + off[context] / total[context] * lower

    def log_p(self, text):
        full = quality.EDGE * (self.order - 1) + text
        return sum(np.log(self.p(full[i : i + self.order])) for i in range(len(text)))


@pytest.mark.parametrize("order", [1, 3, 5])
def test_kneser_ney_by_definition(spark, monkeypatch, order):
    monkeypatch.setattr(quality, "BLOCK", 400)
    rnd = random.Random(order)
    trusted = ["The cat sat on the mat. " * k for k in range(1, 6)] + ["Zoë 42!", "日本語の文章。日本語。", "", "Γειά σου Κόσμε"]
    texts = [*trusted, "the dog sat", "ab" * 700, "日本", "\U0001f600 new", "", None, "the dog sat"] + ["".join(rnd.choices("the catЖ日", k=rnd.randint(1, 60))) for _ in range(40)]
    plain = PlainKneserNey(trusted, order)
    for context in ("", "h", "he", "sat ", "zz"):
        context = context[: order - 1]
        known = {g for g in plain.levels[0][0]}
        assert abs(sum(plain.p(context + c) for c in known) + plain.p(context + "\U0001f601") - 1) < 1e-9
    model = quality.train(spark.createDataFrame([(t,) for t in trusted], "text string"), Scratch(spark, "t"), order)
    scores = quality.text_scores(spark.createDataFrame([(t,) for t in texts], "text string"), model)
    got = {r.digest: (r.chars, r.log_p) for r in scores.collect()}
    assert len(got) == len({t or "" for t in texts})
    for t in texts:
        chars, log_p = got[int(quality._digest([t or ""])[0])]
        assert chars == len(t or "") and abs(log_p - plain.log_p(t or "")) < 1e-6 * max(1, chars)


def test_quality(spark):
    where = SF.replace("0.001", "0.01")
    out = {r.doc_id: r for r in registry.QUERIES["op7_quality"](spark, where).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{where}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    good, bad = [out[i].kept for i, q in labels.items() if q == 1], [out[i].kept for i, q in labels.items() if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_quality_edges(spark):
    some = [(i, f"Good plain text here {i}.", "en") for i in range(10, 40)]
    docs = spark.createDataFrame([*some, (1, "Good plain text here.", "en"), (2, None, None), (3, "", "en"), (None, "x" * 100000, "fr"), (1, "Good plain text here.", "en")], "doc_id long, text string, lang string").withColumn("chars", F.lit(5))
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (1, 1, 0), *[(i, 1, 0) for i, _, _ in some]], "doc_id long, quality int, toxic int")
    out = quality.quality(docs, labels)
    rows = out.collect()
    assert out.columns == [*docs.columns, "perplexity", "threshold", "kept"] and len(rows) == 35
    assert [r.kept for r in rows] == [r.doc_id is not None for r in rows]
    assert quality.quality(docs, labels.limit(0)).where("not kept").count() == 0 and quality.quality(docs.limit(0), labels).count() == 0


def test_repeated_runs_of_words(spark):
    rnd = random.Random(3)

    def some(n):
        return [f"w{rnd.randrange(10**6)}" for _ in range(n)]

    rows = [(i, " ".join(some(rnd.randrange(0, 160))), "s") for i in range(40)]
    passage, short, twin = some(60), some(49), some(55)
    for i in (50, 51, 52):  # in the midst of sentences
        rows.append((i, " ".join([*some(9), *passage, *some(9)]) + ". End.", "s"))
    rows += [(i, " ".join([*some(7), *short, *some(7)]), "s") for i in (60, 61)]
    rows += [(70, "É " + "\n".join([*twin, *some(3), *twin]), "s"), (71, None, "s"), (72, "", "s"), (None, " ".join([*twin, *twin]), "s"), (None, "", "s"), (80, " ".join(["ha"] * 70), "s")]
    docs = spark.createDataFrame(rows, DOCS)
    out = substring_dedup.remove_repeated_spans(docs.repartition(3), words=50).collect()
    assert sorted(len(r.text) for r in out if r.doc_id is None) == [0, len(" ".join(twin)) + 1]
    rows = [r for r in rows if r[0] is not None]
    got = {r.doc_id: r.text for r in out if r.doc_id is not None}
    seen, want = set(), {}
    for i, text, _ in rows:  # by brute force: each run of 50 words and its first place
        w, away, own = words(text), set(), {}
        for p in range(len(w) - 49):
            run = tuple(w[p : p + 50])
            if run in seen or p - own.setdefault(run, p) >= 50:
                away.update(range(p, p + 50))
        seen |= own.keys()
        want[i] = [x for p, x in enumerate(w) if p not in away]
    assert {i: words(t) for i, t in got.items()} == want
    assert [len(want[i]) for i in (50, 51, 52, 60, 61, 70, 80)] == [79, 19, 19, 63, 63, 59, 70]
    assert got[71] is None and got[72] == "" and got[70].startswith("É ")
