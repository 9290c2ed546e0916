"""Filter audit, I-Match and whitening against brute force, with awkward rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from lumenscan.llm import filter_audit, imatch, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, last string, bits int, rank long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, p, "s", "x", 3, 4) for i, t, p in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = [f"word{k}" for k in range(3000)]
    texts = [None, "", " \n", "one", "A" * 300, "a#b " * 150, "é " * 120, "lone " * 90000, " ".join(r.choices(vocabulary, k=130))]
    texts += [" ".join(r.choices(vocabulary[:k], k=n)) for k, n in itertools.product((40, 400, 3000), (20, 99, 100, 101, 600))]
    base = " ".join(vocabulary[:150])
    texts += [base + x for x in "abc"] + ["B" + base] * 3  # equal lengths, late and early differences
    long = "x" * 5000
    texts += [long + "y", long + "z", long + "y"]
    out = [(k, t, ("en", "de", None)[k % 3]) for k, t in enumerate(texts * 2)]
    out += [(7, out[7][1], "en"), (3, "one", "fr"), (None, "one", "fr"), (None, "only here", None), (None, "only here", None), (-5, "one", "fr")]
    return out


LABELS = [(k, k % 2, (k // 2) % 2) for k in range(0, 50)] + [(4, 0, 1), (4, None, None), (None, 1, 1)]


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, p in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((p or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone, before = [d for d in left if f in d[1]], set(order[:k])
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in d[1] and bool(d[1] & before) for d in mine), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


@pytest.mark.parametrize("bits", [64, 2])
def test_filter_audit(spark, rows, bits):
    """With 2 bits nearly all texts of one length collide, and only the comparison of whole texts tells them apart."""
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.orders(filter_audit.mask_counts(table(spark, rows), labels, bits))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got.collect()} == brute_audit(rows, LABELS)


def test_words_of_huge_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices([f"w{k}" for k in range(50)], k=900)).encode()
    whole = filter_audit._words(text)
    monkeypatch.setattr(filter_audit, "PIECE", 13)
    assert filter_audit._words(text) == whole == (900, 50)




def test_imatch_with_unique_ids(spark, rows):
    mine = [(k, t, p) for k, (_, t, p) in enumerate(rows)]
    got = {r.doc_id: r for r in imatch.fingerprints(table(spark, mine)).collect()}
    assert len(got) == len(mine)
    by_text = {}
    for k, (i, t, _) in enumerate(mine):
        t, after = t or "", mine[(k + 1) % len(mine)][1] or ""
        r, cut = got[i], len(t) // 4
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        if t == after:
            assert r.near_next == 1
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1


def test_imatch_slots_by_hand(spark):
    """Fingerprints of a small table from their definition, the band included."""
    r = random.Random(2)
    texts = [" ".join(r.choices([f"t{k}" for k in range(300)], k=n)) + " Common" for n in (5, 40, 100, 300)] + ["lone words here", "COMMON", ""]
    docs = [(k, t, "en") for k, t in enumerate(texts)]

    def terms(t):
        return set(re.findall(r"[0-9a-z]+", t.lower()))

    df = {}
    for t in texts:
        for x in terms(t):
            df[x] = df.get(x, 0) + 1
    for row in imatch.fingerprints(table(spark, docs)).collect():
        found = terms(texts[row.doc_id])
        level = max(len(bin(len(found))) - 2 - 6, 0)
        drawn = [(x, int(hashlib.md5(x.encode()).hexdigest()[0], 16), int(hashlib.md5(x.encode()).hexdigest()[1:8], 16)) for x in found]
        drawn = [x for x in drawn if x[2] < (1 << 28) >> level]
        band = [x for x in drawn if df[x[0]] * 2 <= len(texts)]
        slots = []
        for part in range(16):
            for k in range(3):
                subset = sorted(x[0] for x in band or drawn if x[1] == part and x[2] < (1 << 28) >> (level + k))
                slots.append(hashlib.md5(" ".join(subset).encode()).hexdigest()[:8] if subset else "")
        assert row.fingerprint == f"{level}:{','.join(slots)}"


def test_imatch_repeats_and_nulls(spark, rows):
    got = imatch.fingerprints(table(spark, rows)).collect()
    want = sorted((i is not None, i or 0, len(t or "")) for i, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == want
    single = imatch.fingerprints(table(spark, [(1, "a b c d e f g h", "en")] * 3)).collect()
    assert len(single) == 3 and {r.near_next for r in single} == {1.0}


def test_imatch_is_native(spark, rows):
    plan = imatch.fingerprints(table(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, x string")


def test_whitening(spark):
    r = np.random.default_rng(3)
    data = (r.normal(size=(300, 20)) @ np.diag(2.0 ** np.arange(10, -10, -1) / 8) @ np.linalg.qr(r.normal(size=(20, 20)))[0]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(data)] + [(7, data[7].tolist())] * 40 + [(None, data[3].tolist()), (900, None), (901, [None] + [1.0] * 19), (902, [math.nan] * 20), (903, [math.inf] + [0.0] * 19), (904, [1.0] * 3), (905, []), (906, [3e38] * 20)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    x = np.floor(data.astype(float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * x - s) / n
    z = (n * fit - s) / n
    values, basis = np.linalg.eigh(z.T @ z / n)
    values, basis = values[::-1][:16], basis[:, ::-1][:, :16]
    keep = values > 1e-12 * values[0]
    assert len(got) == (300 + 40 + 1) * keep.sum()
    by = {(q.vec_id, q.component): q for q in got}
    signs = [np.sign(by[0, k + 1].whitened) * np.sign(y[0] @ basis[:, k]) for k in range(keep.sum())]
    for (i, k), q in by.items():
        at = 3 if i is None else i
        assert q.n == n and q.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[at], s))
        assert q.identity_error < 1e-6 and math.isclose(q.explained, values[k - 1] / (z * z).sum(axis=1).sum() * n, rel_tol=1e-6)
        assert math.isclose(q.whitened, signs[k - 1] * (y[at] @ basis[:, k - 1]) / math.sqrt(values[k - 1]), rel_tol=1e-4, abs_tol=1e-4)


def test_jacobi_small_eigenvalues():
    """Graded matrices: tiny eigenvalues to high relative accuracy, odd sizes, ties, one dimension."""
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 17):
        basis = np.linalg.qr(r.normal(size=(n, n)))[0]
        want = 10.0 ** -np.arange(n % 9 + 1).repeat(n)[:n]
        values, vectors = whitening.jacobi((basis * want) @ basis.T)
        assert np.allclose(np.sort(values), np.sort(want), rtol=1e-6) and np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
    scale = 10.0 ** -np.arange(6)
    a = np.eye(6) + 0.1
    values, _ = whitening.jacobi(a * scale[:, None] * scale)
    assert math.isclose(np.prod(values), np.linalg.det(a) * np.prod(scale) ** 2, rel_tol=1e-9)


def test_nothing_to_do(spark):
    none = table(spark, [(1, "x", "en")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0 and imatch.fingerprints(none).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert filter_audit.audit(table(spark, [(1, "x", None)]), labels).count() == 600
