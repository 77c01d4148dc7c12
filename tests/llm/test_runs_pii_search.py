"""Periodic runs, personal data and ranked search against brute force, on tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartweave.llm import pii, queries, runs, search

from .util import SCHEMA, clashing, documents

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(documents(spark)).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def runs_by_definition(w, most_period=None):
    """Maximal stretches of every period; of equal stretches the smallest period counts."""
    found = {}
    for q in range(1, min(len(w) // 2, most_period or len(w)) + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(12, 2 * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(w, found):
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=9), st.integers(1, 6)), max_size=8), st.integers(0, 3))
def test_runs_of_words(parts, copies):
    words = [b"w%d" % x for part, times in parts for x in part * times]
    lists = [words, words[::-1], [], words[:copies] + [b"w0"] * 20]
    bounds, rows = runs.find_runs_of(lists)
    for k, own in enumerate(lists):
        assert [tuple(r) for r in rows[bounds[k] : bounds[k + 1]].tolist()] == runs_by_definition(own)


def test_edges_point_to_the_next_smaller_suffix():
    rng = random.Random(3)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 40))] + [-1]
        smaller, agree = runs.lyndon_edges(w)
        for i in range(len(w) - 1):
            j = next(j for j in range(i + 1, len(w)) if w[j:] < w[i:])
            assert smaller[i] == j
            assert agree[i] == next(k for k in range(len(w)) if w[i + k] != w[j + k])


@pytest.mark.parametrize("shape", ["same", "two", "fibonacci", "blocks"])
def test_sweep_compares_words_in_proportion_to_length(shape):
    """Comparisons are counted, not timed."""

    class Word(int):
        seen = 0

        def __eq__(self, other):
            Word.seen += 1
            return int(self) == int(other)

        def __lt__(self, other):
            Word.seen += 1
            return int(self) < int(other)

        def __gt__(self, other):
            Word.seen += 1
            return int(self) > int(other)

        __hash__ = int.__hash__

    def make(n):
        if shape == "fibonacci":
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            return b[:n]
        return {"same": [0] * n, "two": [0, 1] * (n // 2), "blocks": ([0] * 100 + [1]) * (n // 101)}[shape]

    for n in (2_000, 16_000):
        for flip in (1, -1):
            Word.seen = 0
            runs.lyndon_edges([Word(1 + flip * x) for x in make(n)] + [Word(-2)])
            assert Word.seen <= 12 * n


def test_collapse_runs(spark, docs):
    got = runs.collapse_runs(docs).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert len(got) == len(rows)
    want = []
    for doc_id, text in rows:
        words = [x for x in SPACE.split(text) if x]
        found = runs_by_definition(words, 40)
        want.append((doc_id, len(words), found, collapsed(words, found)))
    have = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(have, key=key) == sorted(want, key=key)
    assert runs.collapse_runs(empty(spark)).count() == 0 and runs.digest_columns(runs.collapse_runs(docs.union(docs))).count() == 2 * len(rows)
    long = spark.createDataFrame([(1, "x " * 400_000 + "y", None, None, 0)], SCHEMA)
    assert runs.collapse_runs(long).first().text == "x y"


def test_runs_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    planted = 0
    for r in docs:
        words = [x for x in SPACE.split(r.text or "") if x]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        elif n > 3000:
            continue
        found = runs_by_definition(words)
        planted += bool(found) and h % 10 == 0
        have = got[r.doc_id]
        assert have.n_runs == len(found) and have.collapsed_sha256 == sha(collapsed(words, found))
        assert have.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in found))
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (have.start, have.length, have.period) == best
        assert have.exponent_milli == (1000 * best[1] // best[2] if found else None)
    assert planted > 5 and len(got) == len(docs)


EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, expression in EXPRESSIONS.items():
        for m in re.finditer(expression, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


PIECES = ["a", "1", "2.", ".", "@", "+", "-", " ", "(", ")", "é", "256", "255", "007", "+49 30 1234567", "a.b@c.d", "4111 1111 1111 1111", "10.0.0.1", "x_%@y-z.w", "_", "00000001"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_base_spans_are_those_of_the_expressions(parts):
    text, order = "".join(parts), {kind: k for k, kind in enumerate(pii.KINDS)}
    found = sorted(pii.spans_of(text, pii.automaton()), key=lambda s: (order[s[0]], s[1]))
    assert [s for s in found if s[0] in pii.BASE] == base_spans(text)
    for kind in pii.KINDS:
        own = [s for s in found if s[0] == kind]
        assert all(a[2] <= b[1] for a, b in zip(own, own[1:]))


def test_spans_from_cues(spark):
    cases = {
        "Account no: 123456789 and more": ["account:12:21"],
        "my konto 12345678, accounting 12345678, account 12ab": ["account:9:17"],
        "IBAN GB82 WEST 1234 5698 7654 32 AND": ["iban:5:32"],
        "iban: GB83WEST12345698765432": [],
        "see https://joe:pw@host.example.com/x": ["email:16:35", "login:4:35"],
        "see https://host.example.com:80/x@y": [],
    }
    docs = spark.createDataFrame([(k, text, None, None, 0) for k, text in enumerate(cases)], SCHEMA)
    got = {r.doc_id: r.spans for r in pii.digest_columns(pii.find_pii(docs)).collect()}
    assert [got[k] for k in range(len(cases))] == [",".join(x) for x in cases.values()]
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "Account no: <account> and more" and clean[4] == "see <login>/x"


def test_find_pii(spark, docs):
    more = spark.createDataFrame([(7, "a@b.co 10.0.0.1 " * 3, None, None, 0), (7, "+49 30 1234567", None, None, 0)], SCHEMA)
    table = documents(spark).unionByName(more)
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest_columns(pii.find_pii(clashing(table))).collect())
    want = Counter()
    for r in table.collect():
        found = base_spans(r.text or "")
        n = Counter(kind for kind, _, _ in found)
        want[r.doc_id, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))] += 1
    assert got == want
    assert pii.find_pii(empty(spark)).count() == 0 and pii.redact(docs).count() == docs.count()


def test_pii_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_pii(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts.items():
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text))
        assert got[doc_id].base_sha256 == sha(listed) and got[doc_id].spans.startswith(listed)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranking(rows, items, most=10):
    docs = [(doc_id, Counter(TERM.findall((text or "").translate(LOWER)))) for doc_id, text in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in sorted(items):
        scored = []
        for doc_id, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(text.translate(LOWER))) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:most])]
    return out


@pytest.mark.parametrize("block_bytes", [search.BLOCK_BYTES, 3000])
def test_search(spark, docs, monkeypatch, block_bytes):
    monkeypatch.setattr(search, "BLOCK_BYTES", block_bytes)
    items = [(1, "THE of and Ünïcode"), (2, "no id here at all"), (3, "ab ab ab"), (4, "!? "), (5, ""), (8, "nowhereatall"), (9, "la les de et un")]
    table = spark.createDataFrame([*items, (1, items[0][1]), (None, "the"), (6, None)], "item_id long, text string")
    index = search.build_index(docs.repartition(3))
    got = [tuple(r) for r in search.search(index, clashing(table)).collect()]
    want = ranking([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sorted(got) == sorted(want, key=lambda r: r[:2])
    assert len({r[0] for r in got}) == 4
    monkeypatch.setattr(search, "PASS_BYTES", 12)
    assert sorted(tuple(r) for r in search.search(index, table).collect()) == sorted(got)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert search.search(search.build_index(empty(spark)), items).count() == 0
    assert search.search(search.build_index(docs), items.limit(0)).count() == 0


def test_best_places_keep_ties_by_id():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores, ids = rng.integers(0, 4, 60), rng.permutation(60)
        want = sorted((k for k in range(60) if scores[k] > 0), key=lambda k: (-scores[k], ids[k]))[:10]
        assert search.best_places(scores, ids, 10).tolist() == want
