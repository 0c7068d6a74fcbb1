"""Each operator against a plain version of its contract, on small tables with odd rows."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paidup.llm import decontaminate, dom, language, licenses, near_copies, neighbours, packing, pieces, repeats, suffix_array
from paidup.llm import token_files, warc, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty, letterless and long texts, a repeated row."""
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdefghé") for _ in range(draw.randrange(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    texts = [say(draw.randrange(1, 300)) for _ in range(40)]
    passage = say(40)
    for k in range(12):
        own = texts[k].split()
        own[draw.randrange(len(own))] = "changed"
        texts += [texts[k], " ".join(own), f"{say(20)}\n{passage} {say(5)}"]
    texts += [None, "", "   ", "12 34 !?", "ab" * 400, "Licensed under the Apache License, Version 2.0.", "a\0b " * 60, say(9000)]
    out = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[3], (None, "no id here", None, None, 10)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with those that the operators make."""
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumn("value", F.lit(1)).withColumn("uid", F.lit(2)).withColumn("n", F.lit(3))


def test_decontamination(spark, docs, rows):
    items = [(1, " ".join(rows[0][1].split()[:20])), (2, "short phrase"), (2, None), (None, "x y"), (3, ""), (10, rows[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lowered(text))
        for i in range(max(len(w) - 12, 1) if w and item is not None else 0):
            windows[tuple(w[i : i + 13])].add(item)
    for limit in (1 << 20, 1):
        got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate.find_contamination(docs, table, phrase_bytes=limit).collect())
        want = collections.Counter()
        for r in rows:
            w, found, hit = ALNUM.findall(lowered(r[1])), set(), set()
            for i in range(len(w)):
                for size in {len(k) for k in windows}:
                    if tuple(w[i : i + size]) in windows and i + size <= len(w):
                        found |= windows[tuple(w[i : i + size])]
                        hit |= set(range(i, i + size))
            want[r[0], len(w), len(hit), tuple(sorted(found))] += 1
        assert got == want
    assert decontaminate.find_contamination(docs.limit(0), table).count() == 0
    assert decontaminate.find_contamination(docs, table.limit(0)).filter("n_hit > 0").count() == 0


def removed(rows, least=100):
    seen, out = set(), collections.Counter()
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - least + 1):
            if data[p : p + least] in seen:
                gone[p : p + least] = b"\1" * least
            seen.add(data[p : p + least])
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("limits", [{}, {"hot": 2, "key_bytes": 1 << 12, "run_bytes": 1 << 12}])
def test_repeats(spark, rows, limits):
    own = [r[:2] for r in rows if r[0] is not None and r is not rows[-2]]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    got = repeats.Repeats(df, **limits).marked().mapInArrow(repeats._digests, kind).collect()
    assert collections.Counter(map(tuple, got)) == removed(own)


def test_repeats_of_empty_tables_and_null_ids(docs):
    assert repeats.Repeats(docs.limit(0)).marked().count() == 0
    assert repeats.Repeats(docs).marked().mapInArrow(repeats._cut, docs.schema).filter("doc_id is null").count() == 1


def test_slices_find_the_same_strings(monkeypatch):
    """A chunk cut into small slices has the same key for every string, and the same hashes at the ends of its runs."""
    draw = np.random.default_rng(3)
    data = draw.integers(97, 101, 4000).astype(np.uint8)
    data[2000:2600] = data[100:700]
    data[3000:3400] = 97
    offsets = np.array([0, 0, 500, 520, 520, 2500, 4000])

    def strings(size):
        monkeypatch.setattr(repeats, "SLICE", size)
        runs = repeats.Runs(data, offsets)
        for at, found in ((runs.start, runs.first), (runs.start + runs.count - 1, runs.last)):
            assert (repeats.strings_at(data, at) == found).all()
        keys = {s + i: k for s, n, k in zip(runs.start.tolist(), runs.count.tolist(), runs.key.tolist()) for i in range(n)}
        assert set(runs.key.tolist()) == set(repeats.key_counts(data, offsets)[0].tolist())
        return keys

    whole = strings(1 << 20)
    assert strings(300) == strings(101) == whole
    text = np.searchsorted(offsets, np.arange(4000), side="right")
    assert set(whole) == {i for i in range(3901) if i + 100 <= offsets[text[i]]}


def test_a_long_text_that_repeats_itself(spark):
    draw = np.random.default_rng(9)
    new = draw.integers(97, 123, 8_000_000).astype(np.uint8).tobytes().decode()
    df = spark.createDataFrame([(1, new + new[:3_000_000]), (2, "x" + new[4_000_000:4_000_200])], "doc_id long, text string")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    got = sorted(tuple(r)[:4] for r in repeats.Repeats(df).marked().mapInArrow(repeats._digests, kind).collect())
    assert got == [(1, 11_000_000, 3_000_000, 1), (2, 201, 200, 1)]


def test_maximal_repeats_have_all_occurrences():
    data = np.frombuffer(b"xabcdeyabcdezabcdqabcd", np.uint8)
    n = len(data)
    array = suffix_array.EnhancedSuffixArray(data, np.arange(n), np.full(n, n))
    left = np.concatenate(([-1], data[:-1].astype(np.int64)))
    found = {(k, tuple(sorted(array.order[a : b + 1].tolist()))) for k, a, b, _, _ in array.maximal_repeats(3, left, np.arange(n))}
    assert found == {(5, (1, 7)), (4, (1, 7, 13, 18))}


def test_token_files(spark, docs, rows):
    path = pieces.tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    files = token_files.write_token_files(docs, path, end=2, file_ids=500)
    got = files.select("path", "start").mapInArrow(token_files._read_back, "doc_id long, start long, n long, crc long").collect()
    want = collections.Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n, r.crc) for r in got) == want
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n for r in got])[:-1].tolist()
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got) or got[0].doc_id is None


@pytest.mark.parametrize("ids", [[7], [0, 1 << 31, 5, 5], list(range(4096)), [50256] * 4096, [3] * 4000 + [1 << 30] * 96])
def test_blocks_come_back(ids):
    assert token_files.unpacked(token_files.packed(np.array(ids, np.uint32))).tolist() == ids


def test_neighbours(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(1500, 24)) * draw.uniform(0.5, 2, (1500, 1))
    x[100:900:2] = x[40]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [None] + [1.0] * 23), (5060, [float("nan")] * 24)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    recall = []
    for q, found in got.items():
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(1500), -np.round(score, 9))) if i != q][:20]
        recall.append(len({i for i, _ in found} & set(best)) / 20)
        assert len(found) == 20 and all(abs(score[i] - s) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert np.mean(recall) >= 0.9
    assert got[40][0][0] == 100 and neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["one large", "lognormal", "256 dims"])
def test_neighbours_of_mixed_norms_and_many_dims(spark, kind):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(4000, 256 if kind == "256 dims" else 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one large":
        x[7] *= 20
    if kind == "lognormal":
        x *= draw.lognormal(size=(4000, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.nearest(table, F.col("vec_id") % 80 == 0).collect():
        got[r.query_id].add(r.vec_id)
    recall = []
    for q in range(0, 4000, 80):
        best = [i for i in np.argsort(-(x @ x[q]), kind="stable")[:21] if i != q][:20]
        assert len(got[q]) == 20
        recall.append(len(got[q] & set(best)) / 20)
    print(kind, np.mean(recall))
    assert np.mean(recall) >= 0.9


def test_licenses(docs, rows):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for r in rows:
        w = ALNUM.findall(lowered(r[1]))
        starts = [i for p in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        g = got[r[0]]
        assert (g.n_words, g.n_base) == (len(w), len(starts))
        assert (g.first_word, g.last_word) == ((min(starts), max(starts)) if starts else (None, None))
    assert [p.label for p in got[next(r[0] for r in rows if r[1] and "Apache" in r[1])].places] == ["apache-2.0"]


def test_whole_licenses_are_told_from_parts_and_notices(spark, tmp_path):
    conditions = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:\n{0}. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer.\n{1}. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution.\n"""
    third = """3. Neither the name of the Example Society nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.\n"""
    disclaimer = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    grant = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.\n"""
    as_is = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    x11 = """\nExcept as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to
        promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."""
    cases = [
        (conditions.format(1, 2) + disclaimer, "bsd-2-clause", 1.0),
        (conditions.format("*", "*") + disclaimer, "bsd-2-clause", 1.0),
        (conditions.format(1, 2) + third + disclaimer, "bsd-3-clause", 1.0),
        (conditions.format(1, 2), "", 0.0),
        (grant + as_is, "mit", 1.0),
        (grant, "", 0.0),
        (grant + "The Software shall be used for Good, not Evil.\n" + as_is, "", 0.0),
        (grant + as_is + x11, "x11", 1.0),
        ("Licensed under the MIT license.", "mit", 0.75),
    ]
    (tmp_path / "data").mkdir()
    data = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    data.write.parquet(str(tmp_path / "data/documents.parquet"))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.op6_licenses(spark, str(tmp_path / "data")).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_template_regions():
    a = licenses.compiled("x", "one <<optional>>two <<optional>>three<<end>><<end>> <<var:2>> four")

    def accepts(text):
        states = a.reach({0})
        for word in text.split():
            states = a.step(states, word)
        return a.final in states

    assert all(map(accepts, ["one four", "one two four", "one two three four", "one x y four", "one two x four"]))
    assert not any(map(accepts, ["one", "two four", "one x y z four", "one four five"]))


OTHER_LANGUAGES = [
    "De gemeente heeft gisteren besloten dat het oude zwembad volgend jaar wordt gesloten omdat de kosten te hoog zijn geworden",
    "La mattina presto il pescatore usciva con la sua barca e tornava soltanto quando il sole era già alto nel cielo azzurro",
    "Bu sabah erkenden kalkıp şehrin en kalabalık pazarına gittim ve taze sebze ile meyve aldım, sonra çay içtim",
    "qxzv kjwq zzkp vrrx wqjk pxzq kkvj zxwq bvxz qqjw kzpx vwzz jxkq",
    "هذا الصباح ذهبت إلى السوق واشتريت بعض الخضروات والفواكه الطازجة",
    "今朝は早く起きて市場へ行き、新鮮な野菜と果物を買いました。",
    "Сегодня утром я рано встал и пошёл на рынок за свежими овощами и фруктами",
]


def test_language(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = spark.createDataFrame([(None, "le la", None, None, 1), (9001, None, "en", "", 0), (9002, "12 !", "en", "", 0)], DOCS)
    model = language.fit(docs)
    found = language.predict(docs.unionByName(odd), model)
    held = found.join(docs, "doc_id").filter("held_out and lang is not null")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    und = {r.doc_id: (r.lang_pred, r.score) for r in found.filter("doc_id > 9000").collect()}
    assert und == {9001: ("und", 0.0), 9002: ("und", 0.0)}
    other = spark.createDataFrame([(9100 + i, t, "x", "y", 0) for i, t in enumerate(OTHER_LANGUAGES)], DOCS).withColumn("score", F.lit(1))
    assert language.predict(other, model).filter("not rejected").count() == 0
    kept = found.filter("doc_id < 9000").join(docs.filter("lang is not null"), "doc_id").agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert kept < 0.005
    nothing = language.predict(odd, language.fit(odd.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


@pytest.mark.parametrize("width, percent, shared", [(3, 85, near_copies.SHARED), (5, 80, 32)])
def test_near_copies(docs, rows, monkeypatch, width, percent, shared):
    sets = {}
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lowered(r[1]))
        sets[r[0]] = {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()
    top = {d: d for d in sets if d is not None}

    def find(d):
        return d if top[d] == d else find(top[d])

    for a in top:
        for b in top:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    for short in (near_copies.SHORT, 1):
        monkeypatch.setattr(near_copies, "SHORT", short)
        monkeypatch.setattr(near_copies, "ROUNDS", 3 if short > 1 else 1)
        got = near_copies.NearCopies(docs, percent, shared=shared, width=width).result().collect()
        assert len(got) == len(rows)
        for g in got:
            assert g.n_shingles == len(sets[g.doc_id])
            assert g.component_id == (None if g.doc_id is None else find(g.doc_id))
            assert g.kept == (g.doc_id == g.component_id)


def test_near_copies_of_one_group_by_blocks(spark, monkeypatch):
    """Copies around the threshold: many pairs are likely, few are links, and no list holds all of them."""
    draw = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(draw.randrange(1, 7)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(40)}"
        texts.append(own)
    sets = [set(zip(w, w[1:], w[2:])) for w in texts]
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and top[a] != top[b]:
                old, new = max(top[a], top[b]), min(top[a], top[b])
                top = [new if t == old else t for t in top]
    assert len(set(top)) > 1
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    for short, compared in ((1, 16), (8, 512)):
        monkeypatch.setattr(near_copies, "SHORT", short)
        monkeypatch.setattr(near_copies, "ROUNDS", 1)
        monkeypatch.setattr(near_copies, "COMPARED", compared)
        got = near_copies.NearCopies(docs).result().collect()
        assert {g.doc_id: g.component_id for g in got} == dict(enumerate(top))


def test_homes_within_lists():
    lists = [np.array([1, 5]), np.array([], np.int64), np.array([7, 2, 1])]
    got = near_copies._within(np.array([1, 7, 9]), lists)
    assert got.tolist() == [[True, False, True], [False, False, True], [False, False, False]]


def test_warc(spark):
    pages = [(3, "http://a/x", "<p>same"), (1, None, "<p>same"), (2, "http://b\r\nX: y", None), (7, "u", ""), (None, "u", "<p>same"), (9, "u", "é" * 90000)]
    archives = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), archive_bytes=1000)
    got = {r.page_id: tuple(r)[1:] for r in warc.read_records(warc.normalise(archives)).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert got[1] == (7, digest("<p>same"), "response", None)
    assert got[3] == (7, digest("<p>same"), "revisit", 1) and got[None] == got[3]
    assert got[2] == (0, digest(""), "response", None) and got[7] == (0, digest(""), "revisit", 2)
    assert got[9][0] == 180000


def test_main_text(spark):
    body = lambda k: f"<html><head><title>t</title></head><body><nav><a>Home</a></nav><article><h1>T{k} &amp; more</h1><p>Subscribe to us</p><p>Own  words\n{k}<br><p>{k} second</article><div class='comments'><p>nice</div><footer>f</footer></body>"
    pages = [(k, f"http://h/{k}", body(k)) for k in range(12)] + [(50, None, None), (51, "http://z/", "<p>only <b>text</b>"), (52, "x", "a < b &lt; c")]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3 & more\n\nOwn words 3\n\n3 second"  # the constant slot is template
    assert (got[50], got[51], got[52]) == ("", "only text", "a < b < c")
    assert dom.parse("<a href='x>").children  # an open quote ends nothing


def test_main_text_with_empty_pages_and_a_second_layout(spark):
    page = lambda k: f"<html><body><article><h1>T{k}</h1><p class=x>Join our list</p><section>Own words {k}</section></article></body>"
    other = lambda k: f"<html><body><article><h2>U{k}</h2><div>Other words {k}</div></article></body>"
    pages = [(100 * h + k, f"http://e{h}/{k}", page(100 * h + k)) for h in range(8) for k in range(9)]
    pages += [(100 * h + 50, f"http://e{h}/", "" if h % 2 else None) for h in range(8)]
    pages += [(5000 + 100 * h + k, f"http://m{h}/{k}", page(100 * h + k)) for h in range(8) for k in range(12)]
    pages += [(5050 + 100 * h + k, f"http://m{h}/o{k}", other(k)) for h in range(8) for k in range(12)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages)
    assert not [k for k, text in got.items() if k < 5000 and "Join our list" in text]
    assert got[103] == "T103\n\nOwn words 103" and got[5052] == "U2\n\nOther words 2"
    # every layout of a host has its own model
    assert not [k for k, text in got.items() if 5000 <= k and "Join our list" in text]


def test_main_text_with_neutral_names_small_hosts_long_notices_and_deep_pages(spark):
    notice = "This notice is the same on every page and " + "has a good many words " * 10
    page = lambda k: f"<div class=c1>Start</div><div class=c2><h1>T{k}</h1><p>Own words {k}<p>More {k}</div><div class=c3>{notice}</div>"
    copy = lambda k: f"<div class=b><h2>U{k}</h2><p>Shared words<p>Also shared<p>Own {k}</div>"
    pages = [(k, f"http://a/{k}", page(k)) for k in range(7)] + [(20 + k, f"http://b/{k}", page(k)) for k in range(2)]
    pages += [(30 + k, f"http://c/{k}", copy(k)) for k in range(4)]
    pages += [(40 + k, f"http://d/{k}", "<div>" * 3000 + f"deep {k}<p>template" + "</div>" * 3000) for k in range(3)]
    pages += [(60, "http://a/0", page(0)), (60, "http://a/0", page(0))]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in wrappers.extract(frame).collect()}
    assert [got[k] for k in range(7)] == [f"T{k}\n\nOwn words {k}\n\nMore {k}" for k in range(7)] and got[60] == got[0]
    assert got[20].startswith("Start") and got[20].endswith("words")  # two pages prove nothing
    assert got[31] == "U1\n\nShared words\n\nAlso shared\n\nOwn 1"  # a slot that varies needs eight pages
    assert [got[40 + k] for k in range(3)] == [f"deep {k}" for k in range(3)]
    assert wrappers.extract(frame.limit(0)).collect() == []


def test_tree_matching_equals_brute_force():
    draw = np.random.default_rng(4)

    def tree(depth):
        below = "".join(tree(depth - 1) for _ in range(draw.integers(0, 4))) if depth else ""
        tag = draw.choice(["div", "section", "ul"])
        return f"<{tag}>{below}</{tag}>"

    def best(node, slot, model):
        def rest(left, right):
            if not left or not right:
                return 0
            own = best(left[0][0], right[0], model) if left[0][0].kind == model[0][right[0]] else 0
            return max(rest(left[1:], right), rest(left, right[1:]), own and own + rest(left[1:], right[1:]))

        return 1 + rest(wrappers.runs(node), model[1][slot])

    for _ in range(60):
        page, model = dom.parse(tree(3) + tree(3)), wrappers.model_of(wrappers.skeleton(dom.parse(tree(3) + tree(3))))
        size, chosen = wrappers.matching(page, 0, model)
        assert size == best(page, 0, model)
        for pairs in chosen.values():
            assert all(run[0].kind == model[0][slot] for run, slot in pairs)
            assert [slot for _, slot in pairs] == sorted((slot for _, slot in pairs), reverse=True)


def test_words_are_encoded_once_and_joined():
    """A word costs one encoding whatever stands around it, and new words go to the tokenizer many at a time."""
    import pyarrow as pa

    encoder = pieces.PieceEncoder(pieces.tokenizer_path("word_bpe_49k.json"), True)
    given, encode = [], encoder._encode
    encoder._encode = lambda texts: given.extend(texts) or encode(texts)
    names = ["".join(c) for c in itertools.product("abcde", repeat=5)][:2000]
    texts = [" ".join(names), " ".join(x.upper() + "." for x in names), " ".join(f"({x.title()})," for x in names)]
    texts += ["T\u0308 t\u0308. \u00d7a\u00f7 It's=\u0338 'tis don'T.x <|endoftext|>a b<|endoftext|> I\u0307. 12a3 \u4e2d x."]
    ids, counts = encoder.encode(pa.array([*texts, None, ""]))
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [*map(len, want), 0, 0]
    assert ids.tolist() == [i for own in want for i in own]
    assert len(given) < 40


def test_packing(docs, rows):
    got = packing.pack(packing.pieces_of(docs, pieces.tokenizer_path("word_bpe_49k.json"), 0, True), group=20).toPandas()
    total = 0
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and own.length.sum() <= packing.LENGTH
        total += own.length.sum()
    assert got.sequence_id.nunique() <= -(-total // packing.LENGTH) + 1
    assert got.groupby("doc_id", dropna=False).ngroups == len({r[0] for r in rows})


def test_packing_groups_stay_bounded(spark):
    """Pieces of over a quarter and under a half of a sequence: every group keeps a gap, and few sequences are quite full."""
    draw = np.random.default_rng(5)
    data = [(i, 0, 0, int(n), i) for i, n in enumerate(draw.integers(512, 1024, 6000))]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    got = packing.pack(spark.createDataFrame(data, kinds), group=1000).toPandas()
    assert sorted(got.doc_id) == list(range(6000))
    assert got.groupby("sequence_id").length.sum().max() <= packing.LENGTH
    assert got.groupby(got.sequence_id // (1 << 30)).size().max() < 1200
    assert got.sequence_id.max() < 4 << 54 and not got.certified.all()


def test_lower_bounds_hold():
    draw = np.random.default_rng(3)
    for _ in range(30):
        sizes = draw.integers(1, 100, draw.integers(1, 60))
        _, _, full = packing.best_fit(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= len(full) and full.max() <= 100
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3


def test_pipeline_stages_keep_the_columns(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    now, kept = docs, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path)
        assert now.columns == docs.columns
        assert now.count() <= kept
        kept = now.count()
    assert kept > 0.8 * docs.count()
    assert corpus_pipeline.run(spark, path).select("doc_id").distinct().count() == kept


def test_the_sample_of_a_language_is_the_same_in_shares(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    order = F.xxhash64(F.col("doc_id"), F.lit(5)), F.col("doc_id")
    two = language._first(language._first(docs, ["lang", "share"], order, 7), ["lang"], order, 7)
    want = {
        name: [r.doc_id for r in docs.filter(F.col("lang") == name).orderBy(*order).limit(7).collect()] for name in ("a", "b")
    }
    got = [(r.lang, r.doc_id) for r in two.collect()]
    assert sorted(got) == sorted((name, i) for name, ids in want.items() for i in ids)
