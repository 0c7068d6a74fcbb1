"""Spelling groups, vector codes and personal data against plain versions of their contracts."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paidup.llm import codebooks, private_data, spelling
from paidup.workspace import Workspace

# --- spelling --------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_groups(rows):
    total = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, n, len(near[w]), forms[w], words.get(forms[w]), root))
    return out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    stems = ["".join(draw.choice("abcé") for _ in range(draw.randrange(4, 8))) for _ in range(60)]
    out = []
    for i in range(300):
        words = [draw.choice(stems) for _ in range(40)]
        for k in range(0, 40, 5):
            at = draw.randrange(len(words[k]))
            words[k] = words[k][:at] + draw.choice(["", "a", "bc"]) + words[k][at + draw.randrange(2) :]
        out.append((i * 7919, draw.choice([" ", ", ", "\n", "_", "1"]).join(words)))
    long = "ab" * 2000
    out += [(1, None), (2, ""), (3, "12 ×÷ßÀ ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿÿ"), (None, "ABCDE abcde Abcde İıſ abcdé"), (4, "aaaaa aaaaaa " * 3)]
    out += [(5, f"{long} {long}a {long[1:]} " * 3), (6, "abcde" * 2), (6, "abcde abcde"), out[0]]
    return out


def test_spelling_groups(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    got = {tuple(r) for r in spelling.spelling_groups(docs).collect()}
    assert got == plain_groups(texts)
    assert {r[3] for r in got if r[3]} and any(r[5] not in (r[0], r[3]) for r in got)


def test_spelling_with_heavy_keys_in_cells(spark, texts, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 2)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {tuple(r) for r in spelling.spelling_groups(docs).collect()} == plain_groups(texts)


def test_near_words_of_a_small_alphabet(spark):
    draw = random.Random(5)
    words = {"".join(draw.choice("ab") for _ in range(draw.randrange(5, 11))) for _ in range(500)} | {"a" * n for n in range(5, 30)}
    table = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
    got = [(r.a, r.b) for r in spelling.near_words(table, Workspace(spark)).collect()]
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


@given(st.lists(st.integers(0, 40), min_size=4, max_size=12))
def test_pivots_are_the_cheapest_disjoint_pair(ranks):
    prefix, places, last = spelling.gram_prefix(ranks)
    assert len(prefix) == 3 and set(prefix) <= set(places) and last == sorted(ranks)[2]
    cost = [ranks[i] for i in prefix]
    a, b = spelling.pivots(prefix, cost)
    pairs = [(ranks[x] + ranks[y]) for x in prefix for y in prefix if y >= x + 2]
    assert b >= a + 2 and ranks[a] + ranks[b] == min(pairs)


def test_spelling_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(docs).collect() == []


# --- vector codes ----------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, v) for i, label, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, label, [int(np.floor(float(x) * 4096)) for x in v]) for i, label, v in kept]
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in sorted(kept, key=lambda r: r[0])[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for _, _, v in kept:
                members[nearest(cut(v, p), p)].append(cut(v, p))
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else books[p][e] for e in range(len(books[p]))]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], collections.Counter()
    for i, label, v in kept:
        choice = [nearest(cut(v, p), p) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][c]) for p, c in enumerate(choice))
        by_label[label] += error
        out.append((i, label, "".join(f"{c:02x}" for c in choice), error))
    return collections.Counter((i, code, error, by_label[label], sha) for i, label, code, error in out)


def vector_rows(n, seed=3):
    draw = np.random.default_rng(seed)
    rows = [(int(i), int(i) % 3 if i % 5 else None, [float(x) for x in np.float32(draw.normal(0, 0.3, 16))]) for i in draw.permutation(n) + 10]
    bad = [(1, 1, None), (2, 1, [None] + [0.1] * 15), (3, 1, [float("nan")] * 16), (4, None, [float("inf")] * 16), (5, 1, [])]
    return rows + bad + [(rows[0][0], 1, rows[0][2]), (900, 2, rows[1][2]), (901, None, [0.0] * 16), (902, 1, [-1e-9] * 16)]


@pytest.mark.parametrize("n", [150, 9])
def test_vector_codes(spark, n):
    rows = vector_rows(n)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    table = table.withColumn("code", F.lit("x")).withColumn("error", F.lit(1))
    folder = Workspace(spark).root
    table.write.parquet(f"{folder}/embeddings.parquet")
    got = codebooks.op13_vector_codes(spark, folder)
    assert collections.Counter(map(tuple, got.collect())) == plain_codes(rows)


def test_vector_codes_of_empty_and_odd_tables(spark):
    schema = "vec_id long, label int, vector array<double>"
    assert codebooks.VectorCodes(spark.createDataFrame([(1, 1, None)], schema)).codes().collect() == []
    odd = spark.createDataFrame([(1, 1, [0.5] * 5), (2, 1, [0.25] * 5), (3, 2, [1.0] * 4), (None, None, [0.5] * 5), (7, 1, [1e9] * 5)], schema)
    coder = codebooks.VectorCodes(odd)
    assert sorted((r.vec_id or 0, r.error) for r in coder.codes().collect()) == [(0, 0), (1, 0), (2, 0)]
    assert sum(b.shape[1] for b in coder.books) == 5


def test_block_distances_by_dictionary(spark):
    rows = np.random.default_rng(1).integers(-50, 50, (40, 6))
    found = [np.unique(x, return_inverse=True) for x in rows.T]
    block = codebooks.Block(
        {
            "sizes": np.array([len(x) for x, _ in found]).tobytes(),
            "dictionary": np.concatenate([x for x, _ in found]).tobytes(),
            "codes": np.stack([x for _, x in found]).astype(np.uint32).tobytes(),
        }
    )
    entries = rows[:5, 2:5]
    assert (block.distances(range(2, 5), entries) == ((rows[:, None, 2:5] - entries) ** 2).sum(axis=2)).all()
    choice = np.arange(40) % 5
    assert (block.sums(range(2, 5), choice, 5) == np.stack([rows[choice == e, 2:5].sum(axis=0) for e in range(5)])).all()


# --- personal data ---------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(x // 10 + x % 10 for x in twice)) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "@", ".", "-", "+", "1", "25", "4111111111111111", "00", " ", "(", ")", "x@y.z", "%", "1.2.3.4"]), max_size=24).map("".join))
def test_base_matches_are_those_of_the_patterns(text):
    assert [c[:3] for c in private_data.candidates(text) if c[3]] == plain_base(text)


def private_texts():
    draw = random.Random(2)
    number = lambda valid: next(x for x in iter(lambda: f"4{draw.randrange(10**15):015d}", "") if plain_luhn(x) == valid)
    texts = []
    for i in range(60):
        texts.append(f"Ähm mail bob.{i}@mail{i}.example.com now, tel +1 ({200 + i}) 555-{1000 + i} or 10.{i}.3.4 and {number(True)} end")
        texts.append(f"pay {number(i % 2 == 1)} order {number(False)} done")
        texts.append(f"plain words only {i}")
        texts.append(f'token = "{draw.randrange(16**40):040x}" here')
    card = number(True)
    texts += [f"two {number(False)} {card} in a row", "ann (at) example (dot) org", "call (415) 555-0199 today", None, "", "  "]
    texts += ["9" * 3_000, "a" * 3_000 + "@", "1." * 1_500, "+1" * 1_500, "1 " * 2_000, "a@" * 1_500, "00000000300.1.1.1 0.0.0.256 1.2.3.4.5.6.7.8"]
    return texts, card


def test_private_data(spark):
    texts, card = private_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("spans", F.lit(1)).withColumn("kind", F.lit("z"))
    folder = Workspace(spark).root
    table.write.parquet(f"{folder}/documents.parquet")
    got = private_data.op11_private_data(spark, folder).collect()
    want = collections.Counter()
    for doc, text in rows:
        base = plain_base(text)
        n = collections.Counter(k for k, _, _ in base)
        sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        want[doc, n["email"], n["ip"], n["card"], n["phone"], sha] += 1
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    by_id = {r.doc_id: r.spans.split(",") if r.spans else [] for r in got}
    for doc, text in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in by_id[doc])]
        base = plain_base(text)
        order = private_data.KINDS.index
        assert spans == sorted(spans, key=lambda x: (order(x[0]), x[1])) and set(base) <= set(spans)
        for kind, a, b in set(spans) - set(base):
            assert not any(a < y and x < b for _, x, y in base)
    found = lambda part: {texts[i][int(a) : int(b)] for i, s in by_id.items() if i is not None for k, a, b in (x.split(":") for x in s) if k == part}
    assert card in found("card") and all(plain_luhn(x.replace(" ", "")) for x in found("card"))
    assert len(found("secret")) == 60 and by_id[2] == [] and by_id[len(texts) - 8] == []


@pytest.mark.parametrize("piece", ["9", "a", "1.", "+1", "1 ", "a@", "f", "(1", "a.", "1:", "@a.", "token="])
def test_candidates_take_time_in_proportion_to_the_text(piece):
    start = time.perf_counter()
    private_data.candidates(piece * 200_000)
    assert time.perf_counter() - start < 10


def test_reliabilities_are_estimated():
    """Votes drawn from known reliabilities: they are found again, and a labeler that guesses is told from a good one."""
    draw = np.random.default_rng(4)
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.5, 0.75])
    true = draw.random(20_000) < 0.4
    says = np.where(draw.random((20_000, 7)) < right, true[:, None], ~true[:, None])
    abstains = draw.random((20_000, 7)) < 0.2
    patterns = collections.Counter("".join("-" if q else str(int(v)) for v, q in zip(a, b)) for a, b in zip(says, abstains))
    found = private_data.estimate(list(patterns), list(patterns.values()))
    assert abs(found.share - 0.4) < 0.02
    assert np.abs(found.sensitivity - right).max() < 0.03 and np.abs(found.specificity - right).max() < 0.03


def test_private_data_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert private_data.PrivateData(docs).spans().collect() == []
