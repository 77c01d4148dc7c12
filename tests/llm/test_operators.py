"""Each operator against a brute-force version or a property, on tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chartweave.llm import bpe, crf, exact, html, lines, lm, minhash, queries, secrets, toxicity, wumanber

from .util import SCHEMA, clashing, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(documents(spark)).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_duplicates(spark, docs, rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc_id))
    got = {r.doc_id: r for r in exact.exact_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        content = re.sub(r"[\x20\x09-\x0D]", "", text)
        group = groups[content]
        r = got[doc_id]
        assert (r.group_size, r.text_sha256) == (len(group), hashlib.sha256(content.encode()).hexdigest())
        assert r.keep_id == min(group)[1] and r.kept == (r.keep_id == doc_id or len(group) == 1)
    assert exact.exact_duplicates(empty(spark)).count() == 0
    assert exact.drop_exact_duplicates(docs).count() == len(groups)


def test_grace_partitions_again_until_buckets_fit():
    rng = random.Random(5)
    contents = [bytes([rng.randrange(256)]) * rng.randrange(1, 400) for _ in range(4000)]
    records = [(hashlib.sha256(c).digest(), c, (-len(c), k), 1) for k, c in enumerate(contents)]
    found = {c: (best, n) for _, c, best, n in exact.grace(records, bucket_bytes=2000)}
    assert {c: n for c, (_, n) in found.items()} == Counter(contents)
    assert all(best == (-len(c), contents.index(c)) for c, (best, _) in found.items())
    same = [(b"\x00" * 32, c, (0, k), 1) for k, c in enumerate([b"a" * 900, b"b" * 900, b"a" * 900] * 50)]
    assert {c: n for _, c, _, n in exact.grace(same, bucket_bytes=1000)} == {b"a" * 900: 100, b"b" * 900: 50}


def test_language_field_labels_code_switched_words(spark):
    rng = random.Random(2)
    vocabulary = {"aa": ["the", "thing", "rather", "with", "other"], "bb": ["queste", "della", "perche", "anche", "molto"]}
    make = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    train = [(k, make("aa" if k % 2 else "bb", 60), "aa" if k % 2 else "bb", "s", 0) for k in range(40)]
    field = crf.fit_languages(clashing(spark.createDataFrame(train + [(99, None, "aa", None, 0), (98, "x", None, None, 0)], SCHEMA)))
    test = spark.createDataFrame([(1, make("aa", 9) + " " + make("bb", 3), None, None, 0), (2, make("bb", 5), None, None, 0), (3, None, "aa", None, 0), (4, "12 !?", None, None, 0)], SCHEMA)
    got = {r.doc_id: r for r in crf.identify(clashing(test), field).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4)] == ["aa", "bb", "und", "und"]
    assert 0.6 < got[1].score < 0.9 and got[2].score > 0.9 and got[3].score == 0
    words = crf.label_words(test, field).where("doc_id = 1").first()
    assert words.langs == ["aa"] * 9 + ["bb"] * 3
    nothing = crf.fit_languages(empty(spark))
    assert {r.lang_pred for r in crf.identify(test, nothing).collect()} == {"und"}


def test_forward_backward_is_the_sum_over_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    lengths, start, move = np.array([3, 1, 4]), rng.random(2), rng.random((2, 2))
    score = rng.random((8, 2))
    post, _ = crf.forward_backward(score, lengths, start, move)
    at = 0
    for n in lengths:
        total = np.zeros((n, 2))
        for path in itertools.product(range(2), repeat=int(n)):
            p = start[path[0]] * score[at, path[0]]
            for k in range(1, n):
                p *= move[path[k - 1], path[k]] * score[at + k, path[k]]
            for k in range(n):
                total[k, path[k]] += p
        assert np.allclose(post[at : at + n], total / total.sum(1, keepdims=True))
        at += n


def brute_components(rows, width, threshold=80):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        sets[doc_id] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, docs, rows, width):
    named = [r for r in rows if r[0] is not None]
    want = brute_components(named, width)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, width=width).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert len(set(v[1] for v in want.values())) < len(want)


def test_near_duplicates_of_a_drifting_family(spark):
    """A family whose members drift apart: links chain, and components must be exact."""
    rng = random.Random(8)
    base = prose(rng, 90).split()
    rows, k = [], 0
    for strand in range(6):
        text = list(base)
        for _ in range(14):
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
            rows.append((k, " ".join(text), None, None, 0))
            k += 1
    rng.shuffle(rows)
    want = brute_components([(r[0], r[1]) for r in rows], 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=4).collect()}
    assert got == want and minhash.near_duplicates(empty(spark)).count() == 0


def test_consensus_extraction(spark):
    long = "Words of the article that go on for long enough to count as text. " * 3
    page = lambda main: f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=1>Home</a></nav><div class='ad'>Buy</div>{main}<div class='comments'><p>{long}{long}</p></div><footer>c</footer></body></html>"
    rows = [(k, "http://a.example/x", page(f"<div class='box-{k}'><div class='story s{k}'><h1>Head &amp; line</h1><p>{long} &lt;b&gt;<p>tw&#111;\n  parts<br>here<script>var x='</p>'</script></div></div>")) for k in range(5)]
    rows += [(10, None, None), (11, "http://b.example/", ""), (12, "http://a.example/y", "<p>just a line &nbsp; of text"), (12, "http://a.example/y", "<p>just a line &nbsp; of text")]
    got = {r.page_id: r for r in html.extract_pages(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    body = " ".join(long.split())
    for k in range(5):
        assert got[k].text == f"Head & line\n\n{body} <b>\n\ntwo parts here"
        assert got[k].n_chars == len(got[k].text)
    assert got[10].text == got[11].text == "" and got[12].text == "just a line of text"
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_line_dedup(spark):
    rng = random.Random(4)
    base = [prose(rng, rng.randrange(1, 40)) for _ in range(60)]
    rows = []
    for doc_id in range(40):
        own = []
        for _ in range(6):
            words = rng.choice(base).split()
            kind = rng.randrange(5)
            spot = rng.randrange(len(words))
            if kind == 1:
                words[spot] = "changed"
            elif kind == 2:
                words.insert(spot, "added")
            elif kind == 3:
                del words[spot]
            own.append("  ".join(words))
        rows.append((doc_id, "\n".join(own), None, None, 0))
    rows += [(100, None, None, None, 0), (101, "", None, None, 0), (102, "\n\n a \n", None, None, 0)]
    first = {}
    for doc_id, text, *_ in rows:
        for n, line in enumerate((text or "").split("\n")):
            if len(words := tuple(line.split())) >= lines.LEAST_WORDS:
                first.setdefault(words, (doc_id, n))
    near = {w for w, at in first.items() if len(w) >= lines.NEAR_WORDS and any(len(v) >= lines.NEAR_WORDS and b < at and lines.within_one_edit(list(v), list(w)) for v, b in first.items() if v != w)}
    want = {(d, n) for d, text, *_ in rows for n, line in enumerate((text or "").split("\n")) if (w := tuple(line.split())) in first and (first[w] != (d, n) or w in near)}
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    assert set(map(tuple, lines.duplicate_lines(df).collect())) == want and near
    cleaned = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert len(cleaned) == len(rows) and cleaned[100].text == "" and cleaned[102].text == "\n\n a \n"
    assert sum(r.n_dropped for r in cleaned.values()) == len(want)
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_keys_of_near_lines_and_long_lines(spark):
    rng = random.Random(14)
    for _ in range(300):
        a = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(8, 20))]
        b = list(a)
        spot, kind = rng.randrange(len(b)), rng.randrange(3)
        if kind == 0:
            b[spot] = "changed"
        elif kind == 1:
            b.insert(spot, "added")
        elif len(b) > 8:
            del b[spot]
        both = lines.Lines([" ".join(a).encode(), "  ".join(b).encode()])
        ids, (keys, counts) = both.ids(), both.keys()
        assert set(keys[0][counts[0]]) & set(keys[1][counts[1]]) and (ids[0] == ids[1]) == (a == b)
        whole, less = both.variants()
        known = {}
        for k, own in enumerate((a, b)):
            known.setdefault(whole[k], tuple(own))
            for j in range(len(own)):
                assert known.setdefault(less[j + (len(a) if k else 0)], tuple(own[:j] + own[j + 1 :])) == tuple(own[:j] + own[j + 1 :])
    same = " ".join(["ab"] * 50_000)
    df = clashing(spark.createDataFrame([(1, same, None, None, 0), (2, same + " ab", None, None, 0), (3, "x " + same, None, None, 0), (4, same + " ab ab", None, None, 0), (None, same, None, None, 0)], SCHEMA))
    assert set(map(tuple, lines.duplicate_lines(df).collect())) == {(2, 0), (3, 0), (4, 0)}


def test_short_and_unspaced_lines_go(spark):
    han, thai = "今天我们去北京看长城和故宫", "วันนี้เราไปเที่ยวกรุงเทพ"
    texts = [f"Les.\ntwo words\n{han}\n{thai}\n\n天", f"Les.\ntwo  words\n{han}\n{thai}\n\n天", f"{han.replace('看', '见')}\n{thai[:9]}{thai[10:]}\n天地\n2024-01-01", "2024-01-02\nLes!\n", None]
    df = clashing(spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA))
    want = {(1, 0), (1, 1), (1, 2), (1, 3), (1, 5), (2, 0), (2, 1)}
    assert set(map(tuple, lines.duplicate_lines(df).collect())) == want
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}[1] == ""


def test_factorization_machine_learns_pairs_of_terms_without_a_signal_of_their_own():
    import numpy as np

    rng = random.Random(16)
    rows, texts = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([f"w{rng.randrange(300)}" for _ in range(30)] + ["alpha"] * a + ["beta"] * b))
        rows.append((int(a != b), toxicity.buckets_of(texts[-1]), 1.0))
    scores = toxicity.Scorer(toxicity.FactorizationMachine().fit(rows[:900])).scores(texts[900:])
    assert np.mean((scores > 0.5) == np.array([r[0] for r in rows[900:]], bool)) > 0.85


def test_toxic_documents_are_found_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    met = queries.op7_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    found = {(r.toxic, r.predicted): r["count"] for r in met}
    assert found[1, 1] / (found[1, 1] + found[1, 0]) > 0.8 and found[1, 1] / (found[1, 1] + found[0, 1]) > 0.8


def test_factorization_machine_learns_pairs(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(1200):
        words = [prose(rng, 12)]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["vermin"] * insult + ["neighbours"] * group
        rows.append((k, " ".join(words), None, None, 0))
        labels.append((k, 1, int(insult and group)))
    rows += [(-1, None, None, None, 0), (-2, "", None, None, 0)]
    df, labels = clashing(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(labels + [(5000, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit_toxicity(df, toxicity.training_labels(labels))
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, machine).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id < 5000 and r.toxic is not None}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k].predicted == truth[k] for k in held) / len(held) > 0.95
    assert got[-1].score == got[-2].score and 0 <= got[-1].score <= 1
    assert toxicity.score_toxicity(empty(spark), toxicity.fit_toxicity(empty(spark), labels)).count() == 0


def test_contamination(spark, docs, rows, monkeypatch):
    rng = random.Random(3)
    texts = [t for _, t in rows if len(t.split()) > 30][:6]
    items = [(k, " ".join(t.split()[5 : 5 + rng.randrange(8, 25)]).upper()) for k, t in enumerate(texts)] + [(50, "Ünïcode!"), (51, None), (52, "?!"), (11, items_text := "no id")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    windows = {}
    for k, t in items:
        w = words(t or "")
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(k)
    want = {}
    for doc_id, text in rows:
        w, hit, owners = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    owners |= windows[x]
        ids = hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest()
        want[doc_id] = (len(w), len(hit), len(owners), ids, bool(hit))
    for size in (wumanber.PASS_BYTES, 200):
        monkeypatch.setattr(wumanber, "PASS_BYTES", size)
        found = wumanber.digest_columns(wumanber.find_contamination(docs, benchmark))
        assert {r[0]: tuple(r)[1:] for r in found.collect()} == want
    assert items_text and wumanber.find_contamination(empty(spark), benchmark).count() == 0
    assert not any(r.contaminated for r in wumanber.digest_columns(wumanber.find_contamination(docs, benchmark.limit(0))).collect())


def test_byte_bpe(spark, docs, rows):
    import tiktoken

    path, pattern = queries.tokenizer_files()
    ranks = bpe.load_ranks(path)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in bpe.encode_documents(docs, path, pattern).collect()}
    assert got == {i: other.encode_ordinary(t) for i, t in rows}
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs, path, pattern), path, pattern).collect()}
    assert back == dict(rows)
    assert all(r.lossless for r in bpe.round_trip(docs, path, pattern).collect())
    own, rng = bpe.tokenizer(path, pattern), random.Random(1)
    for n in (0, 1, 2, 40, 3000):
        for alphabet in ("ab é漢\U0001f600 \n1$'s", "abcdefgh", " \n\t", "\x1c\x85\xa0 a1²"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert own.encode(text) == other.encode_ordinary(text)


def test_language_model(spark, docs, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    named = docs.where("doc_id is not null")
    got = {r.doc_id: r for r in lm.score_documents(named, ~(queries.remainder("doc_id", 7) == 2)).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) + [None] for i, t in rows if i is not None}
    count = Counter(w for i, own in tokens.items() if not held(i) for w in own)
    total, distinct = sum(count.values()), len(count)
    for i, own in tokens.items():
        assert got[i].train_tokens == total and got[i].n_tokens == len(own) and got[i].training != held(i)
        assert got[i].n_known == sum(count[w] > 0 for w in own)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own))
        assert got[i].score < 0
    fresh = spark.createDataFrame([(1, "all new words", None, None, 0)], SCHEMA)
    assert lm.score_documents(fresh, F.lit(False)).first().n_known == 0
    assert lm.score_documents(empty(spark), F.lit(True)).count() == 0


def test_words_that_are_not_listed_are_counted_too(spark, monkeypatch):
    monkeypatch.setattr(lm, "LISTED", 3)
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnopq") for _ in range(k % 40)) + " x" * (k % 3)) for k in range(120)] + [(500, "new words new new"), (501, "")]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 500).collect()}
    count = Counter(w for k, t in rows if k < 500 for w in [*t.split(), None])
    total, distinct = sum(count.values()), len(count)
    for k, t in rows:
        own = [*t.split(), None]
        assert got[k].n_known == sum(count[w] > 0 for w in own)
        assert got[k].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own))


def test_every_training_document_is_learnt_from_once(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, 1 + k % 50)) for k in range(200)] + [(None, "no id here"), (7, prose(rng, 7)), (-1, ""), (-2, "ab " * 20000)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    lex = lm.lexicon(lm.count_words(data), len(rows))
    model = lm.train(data.select("doc_id", F.col("text").cast("binary").alias("data")), lex)
    assert model.seen == lex.tokens == sum(len(t.split()) + 1 for _, t in rows)
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(7)
    texts = F.col("text").cast("binary").alias("data")
    one, two = (lm.train(d.select("doc_id", texts), lex, group_tokens=5_000) for d in (data, shuffled))
    assert one.packed() == two.packed() != model.packed()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_network_beats_the_counts_on_held_out_documents(spark, sf):
    scored = queries.op10_lm_score(spark, f"/root/testdata/{sf}").where("held_out and n_tokens > 20")
    base, score = scored.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_network_learns_and_its_classes_sum_to_one():
    import numpy as np

    from chartweave.llm.gru import GatedModel

    model = GatedModel(np.arange(130, 0, -1.0))
    one = [np.array([k], np.int64) for k in range(130)]
    assert np.exp(model.score(one)).sum() == pytest.approx(1, abs=1e-3)
    text = [np.tile([5, 9, 70, 1], 40) for _ in range(64)]
    before = model.score(text).sum()
    for _ in range(3):
        model.train(text)
    assert model.score(text).sum() > 0.3 * before
    whole, parts = model.score([text[0], text[0][:7]]), model.score([text[0][:7]])
    assert whole[1] == pytest.approx(parts[0])


def test_long_texts_share_the_steps_of_the_network():
    import numpy as np
    import pyarrow as pa

    from chartweave.llm.gru import GatedModel

    model, rng = GatedModel(np.arange(130, 0, -1.0)), np.random.default_rng(4)
    calls = {"output": 0, "score": 0}

    def counted(name, function):
        def call(*args):
            calls[name] += 1
            return function(*args)

        return call

    model.output, model.score = counted("output", model.output), counted("score", model.score)
    one = GatedModel(np.arange(130, 0, -1.0))
    long = rng.integers(0, 130, 5000)
    assert model.score([long])[0] == pytest.approx(one.score([long])[0], rel=1e-5)
    assert calls["output"] == 1  # 157 when every 32 steps had their outputs by themselves
    sizes = [[1, 40, 2000 + k, 7] for k in range(6)] + [[1500], [3, 3]]
    texts = [[rng.integers(0, 130, n) for n in own] for own in sizes]
    rows, at = [], 0
    for own in texts:
        rows.append((pa.RecordBatch.from_pydict({"row": list(range(at, at + len(own))), "words": [[k] * (k % 3) for k in range(len(own))]}), own))
        at += len(own)
    calls["score"] = 0
    got = [(r, w, s) for out in lm.score_parts(iter(rows), model) for r, w, s in zip(out["row"].to_pylist(), out["words"].to_pylist(), out["network"])]
    assert calls["score"] == 7 + 1  # the long texts of all eight parts at once
    assert sorted(r for r, _, _ in got) == list(range(at))
    flat = [(x, k) for own in texts for k, x in enumerate(own)]
    for r, words, score in got:
        assert words == [flat[r][1]] * (flat[r][1] % 3)
        assert score == pytest.approx(one.score([flat[r][0]])[0] / math.log(10), rel=1e-5)


def test_long_texts_wait_for_a_bounded_number_of_ids(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from chartweave.llm.gru import GatedModel

    monkeypatch.setattr(lm, "WAITING", 5_000)
    model, sizes = GatedModel(np.arange(130, 0, -1.0)), []
    score = model.score
    model.score = lambda texts: sizes.append(sum(map(len, texts))) or score(texts)
    parts = [(pa.RecordBatch.from_pydict({"row": [k]}), [np.full(2000, 5)]) for k in range(7)]
    got = [out["row"].to_pylist() for out in lm.score_parts(iter(parts), model)]
    assert sorted(sum(got, [])) == list(range(7)) and sizes == [6000, 6000, 2000]


def test_places_of_hashes():
    import numpy as np

    rng = np.random.default_rng(2)
    top = ~np.uint64(0)
    crowd = np.arange(500, dtype=np.uint64) + np.uint64(1 << 63)
    for words in (np.empty(0, np.uint64), np.array([0], np.uint64), np.array([0, top], np.uint64), crowd, rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)):
        words = np.unique(words)
        place = {int(w): k for k, w in enumerate(words)}
        asked = np.concatenate([words, words + np.uint64(1), rng.integers(0, 1 << 63, 500).astype(np.uint64), np.array([0, top], np.uint64)])
        assert lm.Places(words).find(asked).tolist() == [place.get(int(w), -1) for w in asked]


def test_language_of_secrets_is_counted_over_all_documents(spark):
    rows = [(k, f"Common words, document {k}") for k in range(600)] + [(600 + k, "x" * 9000 + " seltenes\u0130 Wort") for k in range(3)] + [(None, None), (7, "twice"), (7, "twice")]
    language = secrets.learn_language(spark.createDataFrame(rows, "doc_id long, text string"))
    assert language.words == {"common", "words", "document", "seltenes", "seltenesi", "wort"} - {"seltenes" if "seltenesi" in language.words else "seltenesi"}
    counts = [[1] * 27 for _ in range(27)]
    for _, text in rows:
        for w in re.findall("[a-z]+", (text or "").lower()):
            code = [0, *(ord(c) - 96 for c in w), 0]
            for a, b in zip(code, code[1:]):
                counts[a][b] += 1
    want = [[-math.log2(x / sum(row)) for x in row] for row in counts]
    assert all(language.surprise[a] == pytest.approx(want[a]) for a in range(27))
    assert secrets.learn_language(empty(spark)).words == frozenset()


def test_long_candidates_are_whole(spark):
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("abcdefghijkLMNOPQRST0123456789") for _ in range(n))
    key, number, user = draw(6000), "0123456789abcdef" * 40, "u" * 100
    texts = {"opaque": f"see {key}== now", "hex": f"see {number} now", "assignment": f"token={key};", "url_password": f"https://{user}:{key}@host/", "host_token": f"at ghp_{key} now", "chat_token": f"at xoxb-{key} now"}
    for kind, text in texts.items():
        (a, b, got), = secrets.find_candidates(text)
        assert got == kind and (number if kind == "hex" else key) in text[a:b] and b - a < 6010
    for text in ("a/" * 200_000 + "!", "a" * 400_000 + "===", "0a" * 200_000 + "g", "https://" * 50_000, "x://a:" * 50_000, "xoxb-" * 80_000 + "_"):
        secrets.find_candidates(text)
    language = secrets.Language(__import__("numpy").zeros((27, 27)), frozenset(["abc"]))
    assert language.coverage("z" * 600 + "abc" * 200) == 0.5
    labels = {(r.kind, r.label) for r in secrets.example_findings(spark).select("kind", "label").distinct().collect()}
    assert {k for k, label in labels if label} == set(secrets.PATTERNS)


def test_secret_scan(spark):
    language = secrets.learn_language(clashing(documents(spark)))
    forest = secrets.fit_forest(secrets.example_findings(spark, 1200), language)
    key = "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c"
    rows = [(1, f'the text token = "{key}" and more', None, None, 0), (2, "see commit 3f786850e387550fdab836ed7e6dc881de23001b for more", None, None, 0), (3, 'password = "changeme" here', None, None, 0), (4, None, None, None, 0), (5, "", None, None, 0)]
    found = {r.doc_id: r for r in secrets.scan_secrets(clashing(spark.createDataFrame(rows, SCHEMA)), forest, language).collect()}
    assert found[1].secret and found[1].value == key and rows[0][1][found[1].start :][: found[1].length] == key
    assert not found[2].secret and not found[3].secret and set(found) == {1, 2, 3}
    held = secrets.example_findings(spark, 400, seed=77)
    rows = [(k, r.before + r.value + r.after) for k, r in enumerate(held.collect())]
    truth = [r.label for r in held.collect()]
    best = {}
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), forest, language).collect():
        best[r.doc_id] = best.get(r.doc_id, False) or r.secret
    right = sum(best.get(k, False) == bool(t) for k, t in enumerate(truth))
    assert right / len(truth) > 0.9
    assert secrets.scan_secrets(empty(spark), forest, language).count() == 0


def test_pages_of_several_layouts():
    rng = random.Random(21)
    say = lambda n: prose(rng, n)
    for _ in range(20):
        blocks = [say(rng.randrange(8, 40)) for _ in range(8)]
        head, a, b, c, d, e, f, g = blocks
        junk = f"<nav><ul><li><a href=1>{say(2)}</a><li><a href=2>{say(2)}</a><li><a href=3>{say(2)}</a></ul></nav><div class='cookie-banner'>{say(9)}</div>"
        tail = f"<aside>{say(12)}</aside><div id=comments><p>{say(30)}</p></div><footer>{say(9)}</footer><form><label>{say(3)}</label></form><script>{say(5)}</script>"
        whole = "\n\n".join(blocks)
        layouts = [
            f"<main><h1>{head}</h1><section><p>{a}</p><p>{b}</p></section><section><h2>{c}</h2><p>{d}</p></section><div><p>{e}</p></div><p>{f}<p>{g}</main>",
            f"<article><h1>{head}</h1><p>{a}</p><ul><li><a href=x>{b}</a><li><a href=y>{c}</a><li><a href=z>{d}</a></ul><p class=tags-explained>{e}</p><p id=related-work>{f}</p><label>{g}</label><div class=share-buttons>{say(4)}</div></article>",
            f"<div class=post><h1>{head}</h1><div><p>{a}</p><p>{b}</p></div><div><table><tr><td>{c}<td>{d}</tr></table><pre>{e}</pre></div><blockquote>{f}</blockquote><p>{g}</div>",
            f"<div class=wrap><h1>{head}</h1><div class=text><p>{a}<p>{b}<p>{c}<p>{d}</div><div class=text><p>{e}<p>{f}<p>{g}</div></div>",
        ]
        for layout in layouts:
            assert html.Page(f"<html><body>{junk}{layout}{tail}</body></html>").extract(None) == whole


def test_deep_and_broken_pages_take_time_by_their_size():
    assert html.Page("<div>" * 100_000 + "deep &amp; far").extract(None) == "deep & far"
    text = html.Page("".join(f"<div>x{k}</p></span><li>" for k in range(50_000))).extract(None)
    assert text.startswith("x0\n\nx1\n\n") and text.endswith("x49999")


def test_odd_rows_are_dropped_one_by_one(spark):
    rows = [(7, "a b c d e f", "en", "x", 0), (7, "a b c  d e f", "en", "y", 0), (7, "something else here", "en", "x", 0), (None, "a b c d e f", "en", "x", 0), (None, "no id at all", "en", "x", 0), (8, "A b c d e f", "en", "x", 0), (9, None, None, None, None), (9, "", None, None, None), (7, "a b c d e f", "en", "x", 0)]
    df = clashing(spark.createDataFrame(rows, SCHEMA).coalesce(1)).withColumn("row_number", F.lit(1)).withColumn("gone", F.lit(1))
    kept = exact.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.select("doc_id", "text").collect()) == [(0, "no id at all"), (7, "a b c  d e f"), (7, "something else here"), (8, "A b c d e f"), (9, "")]
    near = minhash.drop_near_duplicates(df)
    assert sorted((r.doc_id or 0, r.text or "") for r in near.select("doc_id", "text").collect()) == [(0, "no id at all"), (7, "a b c d e f"), (7, "something else here"), (9, ""), (9, "")]
    field = crf.WordField(["en", "fr"]).fit([("en", "a b c d e f no id at all something else here")] * 3)
    assert crf.drop_unidentified(df, field, 0.3).count() == 7
    bench = spark.createDataFrame([(1, "b c d"), (2, None), (None, "something else here")], "item_id long, text string")
    assert sorted(r.text or "" for r in wumanber.drop_contaminated(df, bench).select("text").collect()) == ["", "", "no id at all", "something else here"]
    assert crf.words_of("a\u00bdb \u2167 x2y") == ["a", "b", "x", "y"] and exact.exact_duplicates(df).where("kept").count() >= 5


def test_shift_tables_in_several_passes(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randrange(1, 60))) for k in range(60)] + [(90 + k, prose(rng, 12).split()[0] + " twice") for k in range(3)]
    docs = [(k, f"{prose(rng, 20)} {' '.join(rng.choice(items)[1].split()[:15])} {prose(rng, 9)}", "en", "x", 0) for k in range(80)]
    df, bench = clashing(spark.createDataFrame(docs, SCHEMA)), spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: r for r in wumanber.find_contamination(df, bench).collect()}
    kept = {r.doc_id for r in wumanber.drop_contaminated(df, bench, least_span=5).select("doc_id").collect()}
    monkeypatch.setattr(wumanber, "PASS_BYTES", 4000)
    parts = {r.doc_id: r for r in wumanber.find_contamination(df, bench).collect()}
    assert {k: (r.n_words, r.spans, r.item_ids) for k, r in whole.items()} == {k: (r.n_words, r.spans, r.item_ids) for k, r in parts.items()}
    assert kept == {r.doc_id for r in wumanber.drop_contaminated(df, bench, least_span=5).select("doc_id").collect()} and 0 < len(kept) < 80


def test_lines_that_share_no_key_seldom_emit_variants(spark, monkeypatch):
    import numpy as np

    from chartweave.llm.common import key_map, on_map

    rng, kept = random.Random(15), {}
    words = lambda: ["".join(rng.choice("aeioulnrst") for _ in range(9)) for _ in range(12)]
    alone = [(k, " ".join(words())) for k in range(6000)]
    near = []
    for k in range(10_000, 13_000):
        line = words()
        near += [(k, " ".join(line)), (k + 10_000, " ".join(line[:5] + ["changed"] + line[6:]))]
    write = lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    df = spark.createDataFrame(alone + near, "doc_id long, text string")
    assert set(map(tuple, lines.duplicate_lines(df).collect())) == {(k, 0) for k in range(20_000, 23_000)}
    assert 6000 <= kept["close-lines"].count() < 6000 + 120
    keys = np.random.default_rng(15).integers(-(1 << 63), 1 << 63, 20_000)
    bits = key_map(spark.createDataFrame([(int(k),) for k in keys[:5000]], "key long"), lines.PROBES)
    found = on_map(bits, keys, lines.PROBES)
    assert found[:5000].all() and found[5000:].mean() < 0.01


def test_a_very_frequent_line_is_cut_over_tasks(spark):
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    small |= {f"spark.sql.adaptive.{k}": v for k, v in (("skewJoin.skewedPartitionThresholdInBytes", "4k"), ("skewJoin.skewedPartitionFactor", "1.5"), ("advisoryPartitionSizeInBytes", "4k"))}
    before = {k: spark.conf.get(k) for k in small}
    rows = [(k, f"the same line\nline {k // 2}") for k in range(12_000)]
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        gone = lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
        assert set(map(tuple, gone.collect())) == {(k, 0) for k in range(1, 12_000)} | {(k, 1) for k in range(1, 12_000, 2)}
        assert "skew=true" in gone._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
