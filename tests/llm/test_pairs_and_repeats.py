"""Substring dedup, Jaccard join, decontamination and quality rules against plain versions."""

import hashlib
import random
import re

import duckdb
import pytest

from keyfold.llm import _store, decontaminate, jaccard_join, jaccard_links, quality_rules, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}


def frame(spark, texts, ids=None, extra=False):
    ids = ids or range(len(texts))
    rows = [(i, t, None, f"s{k % 2}" if k % 7 else None, None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns that operators use inside
        for name in ("row", "sig", "n", "token", "label", "words", "lines", "host", "key", "salt", "spans", "score", "hits", "start"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(3)


def corpus(seed, n=60):
    """Texts with near copies, shared passages, repeated lines, odd white space and empty ones."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("a", "É", "o1", "x")]
    passage = " ".join(rng.choice(words) + str(k) for k in range(60))
    texts = []
    for k in range(n):
        own = [rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 90))]
        if k % 5 == 0:
            own = passage.split()[: rng.randrange(40, 60)] + own[: rng.randrange(0, 14)]
        if k % 3 == 0 and texts:
            own = (rng.choice(texts) or "a").split(" ")
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
        for _ in range(len(own) // 12):
            own[rng.randrange(len(own))] += "\n"
        texts.append(" ".join(own))
    return [*texts, None, "", " \n\t ", "a", "A", texts[3], "one two three four", "ONE  two\tthree four", "w " * 3000]


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


@pytest.mark.parametrize(("seed", "hot"), [(1, 100_000), (2, 2)])
def test_jaccard_components(spark, seed, hot):
    texts = corpus(seed)
    got = jaccard_join.components(frame(spark, texts, extra=True), hot_list=hot).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(texts)


def test_jaccard_odd_rows(spark):
    assert jaccard_join.components(frame(spark, []).where("false")).count() == 0
    text = " ".join(f"w{k}" for k in range(30))
    got = jaccard_join.components(frame(spark, [text, text, None, "", text], ids=[7, 7, None, 3, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == [
        ("3", 0, "3"), ("7", 26, "7"), ("7", 26, "7"), ("None", 0, "None"), ("None", 26, "7"),
    ]


def near_copies(seed, n=90):
    """Groups in which most texts link, some only through others, with copies, chains and two hubs."""
    rng = random.Random(seed)
    hubs = [[f"h{h}w{k}" for k in range(80)] for h in range(2)]
    hubs.append(hubs[0][:60] + hubs[1][:14])
    texts = []
    for k in range(n):
        own = list(hubs[k % 3])
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(own[: len(own) - rng.randrange(0, 12)]))
    chain = [f"c{k}" for k in range(140)]
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 80, 4)]
    return [*texts, *rng.sample(texts, 15), None, "", "own text", "own  TEXT", *corpus(seed, 20)]


@pytest.mark.parametrize(("seed", "hot", "block"), [(1, 100_000, 256), (2, 5, 3)])
def test_every_jaccard_link(spark, monkeypatch, seed, hot, block):
    monkeypatch.setattr(jaccard_links, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_links, "BLOCKS_TOGETHER", 4)
    monkeypatch.setattr(jaccard_links, "PIECE", 16)
    texts = near_copies(seed)
    docs = frame(spark, texts, extra=True)
    sets = [frozenset(shingles(t)) for t in texts]

    def linked(a, b):
        return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)

    want = {}
    for k, (n, component) in components(texts).items():
        links = sum(linked(sets[k], s) for s in sets) - 1 if sets[k] else 0
        want[k] = (n, component, sets.index(sets[k]) if sets[k] else k, links)
    got = jaccard_links.report(docs, hot_list=hot).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["class_id"], r["n_links"]) for r in got} == want
    if hot > 5:  # pairs are the slow part, and small blocks the harder case
        return
    of = {r["sig"]: sets[r["doc_id"]] for r in jaccard_join.classes(docs).where("sig is not null").collect()}
    found = [(r["a"], r["b"]) for r in jaccard_links.pairs(docs, hot_list=hot).collect()]
    assert len(found) == len(set(found)) > 200
    every = {(a, b) for a in of for b in of if a < b and linked(of[a], of[b])}
    assert set(found) == every


def test_links_of_odd_rows(spark):
    assert jaccard_links.report(frame(spark, []).where("false")).count() == 0
    text = " ".join(f"w{k}" for k in range(30))
    got = jaccard_links.report(frame(spark, [text, text, None, "", text, text + " y"], ids=[7, 7, None, 3, None, None])).collect()
    assert sorted(tuple(map(str, r)) for r in got) == [
        ("3", "0", "3", "3", "0"), ("7", "26", "7", "7", "3"), ("7", "26", "7", "7", "3"),
        ("None", "0", "None", "None", "0"), ("None", "26", "7", "7", "3"), ("None", "27", "7", "None", "3"),
    ]


def hits(texts, items):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))

    out = {}
    for k, text in enumerate(texts):
        own, marked, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            n = min(10, len(w))
            for a in range(len(w) - n + 1 if n else 0):
                for p in range(len(own) - n + 1):
                    if own[p : p + n] == w[a : a + n]:
                        marked.update(range(p, p + n))
                        found.add(str(item_id))
        out[k] = (len(own), len(marked), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(marked))
    return out


def test_decontamination(spark):
    rng = random.Random(5)
    word = [f"w{k}" for k in range(6)]
    items = [(k, " ".join(rng.choice(word) for _ in range(rng.randrange(0, 25)))) for k in range(12)]
    items += [(100, "Rare, SHORT one!"), (101, None), (102, "solo"), (103, items[1][1]), (9, "é ü ß " * 5)]
    texts = [" ".join(rng.choice(word) for _ in range(rng.randrange(0, 60))) for _ in range(20)]
    texts += [f"x {i} y" for _, i in items if i] + ["rare-short ONE", None, "", "solo solo", "w1 " * 400]
    got = decontaminate.contamination(frame(spark, texts, extra=True), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == hits(texts, items)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(frame(spark, ["a b", None]), none).collect()
    assert sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in got) == [(0, 0, False), (2, 0, False)]
    assert decontaminate.contamination(frame(spark, ["a"]).where("false"), none).count() == 0


def test_repeated_passages_go_once(spark):
    rng = random.Random(3)

    def fresh(n):
        return [f"{rng.randrange(10**9):x}" for _ in range(n)]

    passage = fresh(70)
    texts = []
    for _ in range(12):
        before, behind = fresh(rng.randrange(0, 60)), fresh(rng.randrange(0, 60))
        texts.append(" ".join(before) + rng.choice([" ", "\n"]) + " ".join(passage).upper() + rng.choice([" ", "\n"]) + " ".join(behind))
    clean = [" ".join(fresh(80)) for _ in range(8)] + ["short line\nshort line\nother", None, "", "é" * 40]
    got = {r["doc_id"]: r for r in substring_dedup.dedup(frame(spark, texts + clean, extra=True)).collect()}
    assert got[0]["n_removed"] == 0 and got[0]["text"] == texts[0]
    for k, text in enumerate(texts + clean):
        spans = [tuple(map(int, s.split(":"))) for s in got[k]["removed"].split(",") if s]
        left, at = "", 0
        for start, end in spans:
            left, at = left + text[at:start], end
        assert got[k]["text"] == (None if text is None else left + text[at:])
        assert got[k]["n_removed"] == len(spans)
        if 0 < k < len(texts):
            removed = " ".join(text[a:b] for a, b in spans).lower().split()
            assert len(removed) >= 30 and set(removed) <= set(passage)
        if k >= len(texts):
            assert not spans


def test_repeats_of_whole_documents_and_odd_rows(spark):
    text = "\n".join(" ".join(f"l{line}w{k}" for k in range(20)) for line in range(4))
    got = substring_dedup.dedup(frame(spark, [text, text, text, "x"], ids=[5, 2, 2, None])).collect()
    assert sorted((str(r["doc_id"]), r["removed_words"]) for r in got) == [("2", 0), ("2", 0), ("5", 80), ("None", 0)]
    assert substring_dedup.dedup(frame(spark, ["a"]).where("false")).count() == 0


def test_passages_go_whole_and_short_lines_and_copies_too(spark):
    rng = random.Random(8)

    def fresh(n):
        return [f"{rng.randrange(10**9):x}" for _ in range(n)]

    passages = [fresh(n) for n in (16, 17, 30, 51, 51, 51, 66, 70) * 4]
    texts = [" ".join(w for p in passages for w in [*p, *fresh(3)]) + "\nall rights reserved"]
    for p in passages:
        texts.append(" ".join(fresh(rng.randrange(1, 30))) + " " + "\n ".join([" ".join(p[:9]), " ".join(p[9:])]) + " " + " ".join(fresh(20)))
    texts += ["own words\nAll  rights reserved\nmore", texts[5], texts[5], None, None, "", "w " * 100]
    ids = [*range(len(texts) - 6), 900, 900, None, None, 901, 902]
    got = substring_dedup.dedup(frame(spark, texts, ids=ids, extra=True), min_line_words=1, each_row=True).collect()
    assert len(got) == len(texts)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["n_removed"] == 0
    for k, p in enumerate(passages, 1):
        (span,) = [tuple(map(int, x.split(":"))) for x in by_id[k]["removed"].split(",")]
        assert texts[k][span[0] : span[1]].split() == p and by_id[k]["removed_words"] == len(p)
    assert by_id[len(passages) + 1]["text"] == "own words\n\nmore"
    assert sorted(r["text"].strip() for r in got if r["doc_id"] == 900) == ["", ""]
    assert 9 <= len(by_id[902]["text"].split()) < 34
    alone = "one two\nthree"
    got = substring_dedup.dedup(frame(spark, [alone, alone, alone], ids=[4, 4, 4]), min_line_words=1, each_row=True).collect()
    assert sorted((r["text"], r["removed_words"]) for r in got) == [("", 3), ("", 3), (alone, 0)]


def test_steps_of_substring_dedup_are_deleted_and_shuffle_texts_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(_store, "shared_folder", lambda _: str(tmp_path))
    texts = corpus(9)
    for each_row in (False, True):
        out = substring_dedup.dedup(frame(spark, [*texts, texts[3]]), min_line_words=1, each_row=each_row)
        assert {p.name.rsplit("-", 1)[0] for p in (tmp_path / "keyfold-llm").iterdir()} == {"marks"}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("xxhash64(") == 1
        assert sum(r["n_removed"] > 0 for r in out.collect()) > 10


@pytest.mark.parametrize("seed", [5, 6])
def test_passages_end_where_the_first_occurrence_differs(spark, seed):
    """Each passage is extended on both sides word by word, against the place where it stood first."""
    rng = random.Random(seed)

    def fresh(n):
        return [f"é{rng.randrange(10**9):x}" for _ in range(n)]

    source = fresh(400)
    texts, cuts = [" ".join(source)], []
    for _ in range(30):
        a = rng.choice([0, rng.randrange(0, 380), rng.randrange(0, 380)])
        b = rng.choice([400, min(400, a + rng.randrange(16, 60))])
        before, behind = fresh(rng.choice([0, 1, 9])), fresh(rng.choice([0, 1, 9]))
        cuts.append((before, source[a:b] if b - a >= 16 else [], behind))
        texts.append(" ".join(before + cuts[-1][1] + behind))
    got = {r["doc_id"]: r for r in substring_dedup.dedup(frame(spark, texts)).collect()}
    for k, (before, passage, behind) in enumerate(cuts, 1):
        assert got[k]["text"].split() == before + behind and got[k]["removed_words"] == len(passage)


def test_quality_rules_equal_sql(spark):
    texts = corpus(4) + ["same line of the site\n" + " ".join(f"u{k}x{j}" for j in range(60)) for k in range(60)]
    texts += ["a b c a b c " * 30, "# $ % & | < > * #", "x\n\nx\n x\nX"]
    docs = frame(spark, texts, extra=True)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    got = quality_rules.judge(docs)
    want = con.execute(quality_rules.oracle_sql())
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    assert got.where("n_line_words > 0").count() > 30
    assert quality_rules.judge(docs.where("false")).count() == 0


def test_boilerplate_lines_are_removed_from_texts(spark):
    line, many = "same  line of the\tsite", 60
    texts = [f"\n{line.upper() if k % 2 else line}\n\n" + " ".join(f"u{k}x{j}" for j in range(60)) for k in range(many)]
    texts += [None, "", "site of the line same", f"{line}\n{line}"]
    rows = [(None if k < 2 else k, t, None, "s" if k != 5 else None, None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    want = ["\n".join(x for x in t.split("\n") if x.lower() != line or k == 5) if t else t for k, t in enumerate(texts)]
    got = quality_rules.cleaned(docs).collect()
    assert sorted(str(r["text"]) for r in got) == sorted(map(str, want))
    for r in got:
        if r["text"] is not None:
            assert r["n_words"] - r["n_line_words"] == len(r["text"].split())
    names = quality_rules.judge(docs).columns
    assert sorted(map(str, quality_rules.judge(docs).collect())) == sorted(str(r) for r in quality_rules.cleaned(docs).select(*names).collect())
    assert quality_rules.cleaned(docs.where("false")).count() == 0
