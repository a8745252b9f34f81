"""Filter audit against SQL, passage sketches and periodic runs against plain versions."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from keyfold.llm import filter_audit, passage_sketch, periodic_runs

DOCS = "doc_id long, text string, lang string, source string, mask int, part string, h string"


def docs(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 7, "x", "y") for i, t, s in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps|", "zeta", "ETA"]) + str(rng.randrange(9)) for _ in range(n))


def audit_rows(seed):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([0, 5, 150, 260])) for _ in range(40)]
    texts += ["word " * 250, "A" * 100, " ".join(f"w{k}" for k in range(230)), "é\x1f   \t\x0b\x0c\r\n", "", None, "long " * 30_000]
    rows = [(rng.choice([None, *range(90)]), rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(150)]
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_sql(spark, seed):
    rows = audit_rows(seed)
    rng = random.Random(seed)
    marks = [(rng.choice([None, *range(100)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("d", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.register("l", pd.DataFrame(marks, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    con.execute("create view documents as select cast(doc_id as bigint) doc_id, cast(text as varchar) as text, cast(source as varchar) as source from d")
    con.execute("create view labels as select * from l")
    want = con.execute(filter_audit.oracle_sql())
    columns = [c[0] for c in want.description]
    got = filter_audit.audit(docs(spark, rows), labels)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_audit_when_the_sketch_is_full(spark, monkeypatch):
    rows = audit_rows(3)
    full = sorted(map(tuple, filter_audit.masks(docs(spark, rows)).collect()), key=str)
    monkeypatch.setattr(filter_audit, "_cells", lambda h, cells: (h.view(np.uint64) & np.uint64(7), h.view(np.uint64) >> np.uint64(61)))
    assert sorted(map(tuple, filter_audit.masks(docs(spark, rows)).collect()), key=str) == full


def test_unique_texts_are_cleared(spark):
    hashes = spark.range(1000).selectExpr("xxhash64(id) h").union(spark.range(10).selectExpr("xxhash64(id) h"))
    bits = filter_audit.repeated_cells(hashes, 1 << 16)
    again = {r.h for r in spark.range(10).selectExpr("xxhash64(id) h").collect()}
    held = np.unpackbits(bits).sum()
    assert 2 * len(again) <= held < 80
    for h in again:
        for cell in filter_audit._cells(np.array([h]), 1 << 16):
            assert bits[int(cell[0]) >> 3] >> (7 - int(cell[0]) % 8) & 1


def test_audit_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs(spark, []), empty).count() == 0
    assert filter_audit.audit(docs(spark, [(1, None, None)]), empty).count() == 600


def ordered(rows):
    """Descending id, none last; rows that repeat one in any order a test may allow."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def jaccard(a, b):
    a, b = (set(passage_sketch.digests([t])[0].tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("piece_chars", [1 << 24, 3000])
def test_fingerprints_equal_a_plain_version(spark, monkeypatch, piece_chars):
    monkeypatch.setattr(passage_sketch, "PIECE_CHARS", piece_chars)
    monkeypatch.setattr(passage_sketch, "CHUNK_CHARS", 5000)
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "é\U0001f600x", prose(rng, rng.randint(1, 400)), prose(rng, 30).replace(" ", "\n")]), "s") for i in rng.sample(range(-500, 500), 120)]
    rows += [(7000, "big " + prose(rng, 40_000), "s"), (7001, rows[3][1], "s")]
    got = {r.doc_id: r for r in passage_sketch.fingerprints(docs(spark, rows).repartition(5)).collect()}
    plain = [(i, t or "") for i, t, _ in ordered(rows)]
    assert len(got) == len(plain)
    for k, (i, text) in enumerate(plain):
        after = plain[(k + 1) % len(plain)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == pytest.approx(jaccard(text, edited)) and row.near_next == pytest.approx(jaccard(text, after))
        assert row.fingerprint == passage_sketch.sketches(*passage_sketch.digests([text])).encoded([len(passage_sketch.digests([text])[0])])[0]
        assert (row.fingerprint == row.edited_fingerprint) >= (text == edited)
    assert len(base64.b64decode(row.fingerprint)) == 4 + 16 * passage_sketch.CELLS


def test_fingerprints_of_odd_rows(spark):
    assert passage_sketch.fingerprints(docs(spark, [])).count() == 0
    one = passage_sketch.fingerprints(docs(spark, [(None, "a b c d", None)])).collect()
    assert [(r.doc_id, r.near_edited < 1, r.near_next) for r in one] == [(None, True, 1.0)]
    # equal rows follow one another, the last of them the next id
    rows = [(5, "one two three four", "s")] * 700 + [(4, "five six seven eight", "s"), (None, "x", "s"), (None, None, "s")]
    got = passage_sketch.fingerprints(docs(spark, rows).coalesce(1)).collect()
    assert len(got) == 703 and sum(r.doc_id == 5 and r.near_next == 1.0 for r in got) == 699


def test_small_sketches_are_retried_larger():
    rng = random.Random(5)
    a = [prose(rng, n) for n in (3000, 10, 0, 700)]
    b = [a[0][: len(a[0]) // 3] + prose(rng, 2000), a[1], "new words here", a[3] + " tail"]
    one, two = passage_sketch.digests(a), passage_sketch.digests(b)
    pair, digest, sign = passage_sketch.differing(one, two, passage_sketch.sketches(*one).subtract(passage_sketch.sketches(*two)))
    for k in range(4):
        x, y = (set(d[0][d[1][k] : d[1][k + 1]].tolist()) for d in (one, two))
        assert set(digest[(pair == k) & (sign == 1)].tolist()) == x - y
        assert set(digest[(pair == k) & (sign == -1)].tolist()) == y - x
    assert (pair == 0).sum() > 24 > (pair == 3).sum() > 0


def plain_runs(words, least=periodic_runs.LEAST):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                part = words[i : j + q]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, letters = rng.randint(0, 170), rng.choice([1, 2, 2, 3, 8, 60])
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.6 and n > 4:
            i = rng.randrange(n)
            p = rng.randint(1, max(1, (n - i) // 2))
            words = words[:i] + [words[i + k % p] for k in range(n - i)]
        if rng.random() < 0.1:
            x, y = [b"a"], [b"a", b"b"]
            while len(y) < n:
                x, y = y, y + x
            words = y
        yield words


@pytest.mark.parametrize("widest", [1 << 14, 4])
def test_runs_equal_all_stretches(monkeypatch, widest):
    monkeypatch.setattr(periodic_runs, "WIDEST", widest)
    texts = list(run_texts(6, 200))
    for k in range(0, len(texts), 3):
        assert periodic_runs.runs_of(texts[k : k + 3]) == [plain_runs(t) for t in texts[k : k + 3]]


def test_transforms_give_exact_products():
    rng = np.random.default_rng(7)
    a, b = (rng.integers(0, periodic_runs.PRIME, (2, 16), dtype=np.uint64) for _ in range(2))
    a[:, 8:], b[:, 8:] = 0, 0
    got = periodic_runs.inverse(periodic_runs.transform(a) * periodic_runs.transform(b) % periodic_runs.P)
    for k in range(2):
        want = [sum(int(a[k, i]) * int(b[k, j]) for i in range(16) for j in range(16) if i + j == m) % periodic_runs.PRIME for m in range(16)]
        assert got[k].tolist() == want


def test_run_report_equals_a_plain_version(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(t.decode() for t in words), "s") for i, words in enumerate(run_texts(9, 150))]
    rows += [(None, "a b " * 30, "s"), (3, None, "s"), (3, None, "s"), (11, " \t\x1c  x\r\n" * 20, "s"), (12, "same " * 50_000, "s")]
    rows += [(i, prose(rng, 300), "s") for i in range(1000, 1200)]
    got = sorted(map(tuple, periodic_runs.report(docs(spark, rows)).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        words = (text or "").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
        words = [w.encode() for w in words if w]
        n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 0
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        found = [(0, n, 1)] if n == 50_000 and len(set(words)) == 1 else plain_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for s, e, q in found for k in range(s + q, s + e)}
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((
            doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            digest("".join(f"{s},{e},{q}\n" for s, e, q in found).encode()),
            digest(b" ".join(w for k, w in enumerate(words) if k not in gone)),
        ))
    assert got == sorted(want, key=str)
    assert periodic_runs.report(docs(spark, [])).count() == 0
