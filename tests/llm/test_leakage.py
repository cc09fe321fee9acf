import random

import pytest

from plumbline.llm.leakage import SizeClass, contained_items, leak_shares, leaked_items, words_of

DOC = "doc_id bigint, text string, item_id string, words string"
ITEM = "item_id bigint, text string, doc_id string"
VOCABULARY = [f"w{i}" for i in range(12)]


def brute(docs, items, run, short=False, shingle=5):
    out = set()
    for d, t, *_ in docs:
        w = words_of(t)
        for i, u, *_ in items:
            v = words_of(u)
            n = run if len(v) >= run else len(v)
            if i is None or d is None or n < run and (not short or n < shingle):
                continue
            have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if any(tuple(v[k : k + n]) in have for k in range(len(v) - n + 1)):
                out.add((d, i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("short", [False, True])
def test_against_brute_force(spark, rows, short):
    r = random.Random(short)
    text = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    items = [(i, text(r.choice((3, 6, 8, 9, 30))), "q") for i in range(30)] + [(99, None, "q"), (98, "", "q"), (None, text(20), "q")]
    docs = []
    for i in range(450):
        t = text(r.randrange(40))
        if r.random() < 0.5:
            w = (r.choice(items[:30])[1]).split()
            s = r.randrange(len(w))
            t += " " + " ".join(w[s : s + r.randrange(15)]) + " " + text(5)
        docs.append((i, t, "q", "q"))
    docs += [(500, None, "", ""), (501, "", "", ""), (502, " \n", "", ""), (503, items[5][1], "", ""), (503, items[5][1], "", "")]
    a, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items + items, ITEM)
    got = rows(leaked_items(a, b, min_run=9, whole_short_items=short))
    assert got == brute(docs, items, 9, short)
    assert len(got) > 20


def test_long_runs_are_divided_and_lose_nothing(spark, rows):
    r = random.Random(9)
    items = [(i, " ".join(f"t{r.randrange(50)}" for _ in range(300)), "") for i in range(6)]
    docs = [(i, "x " + " ".join(items[i % 6][1].split()[5 * i : 5 * i + 10 + 40 * (i % 7)]) + " y", "", "") for i in range(40)]
    a, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    assert rows(leaked_items(a, b)) == brute(docs, items, 12)


def test_shares_are_exact(spark):
    r = random.Random(4)
    items = [(i, " ".join(f"t{r.randrange(9)}" for _ in range(n)), "") for i, n in enumerate((12, 13, 40, 80))]
    docs = [(i, f"x {i} " + " ".join(items[i % 4][1].split()[i % 3 : i % 3 + 11 + i]), "", "") for i in range(24)]
    got = {(x.doc_id, x.item_id): (x.shared_shingles, x.item_shingles) for x in leak_shares(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    want = {}
    for d, t, *_ in docs:
        w = t.split()
        have = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for i, u, *_ in items:
            v = u.split()
            places = {p for k in range(len(v) - 11) if tuple(v[k : k + 12]) in have for p in range(k, k + 8)}
            if places:
                want[d, i] = (len(places), len(v) - 4)
    assert got == want and len(want) > 15


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_whole_items_inside_long_documents(spark, threshold):
    r = random.Random(7)
    items = [(i, " ".join(f"v{r.randrange(4000)}" for _ in range(r.choice((6, 15, 40, 150)))), "") for i in range(40)]
    docs, want = [], set()
    for i in range(400):
        w = [f"v{r.randrange(4000)}" for _ in range(r.choice((0, 30, 900)))]
        item, text, _ = items[i % 40]
        v, at = text.split(), r.randrange(len(w) + 1)
        for _ in range(r.choice((0, 0, 1, 2))):  # each change breaks up to five shingles
            v[r.randrange(len(v))] = "changed"
        docs.append((i, " ".join(w[:at] + v + w[at:]), "", ""))
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    for d, t, *_ in docs:
        have = shingles(t.split())
        want |= {(d, i) for i, u, _ in items if len(shingles(u.split()) & have) >= threshold * len(shingles(u.split()))}
    found = contained_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), threshold=threshold)
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert got <= want  # verified: nothing beyond
    assert len(got) >= 0.97 * len(want) > 100


def test_classes_grow_by_a_quarter_and_cover_all_sizes():
    for n in range(1, 3000):
        c = SizeClass.of(n, 0.8, 0.99)
        assert c.low <= n <= c.high <= max(4, 1.25 * c.low) and c.window >= c.high and c.bands * c.rows <= 64


def test_disguises(spark, rows):
    passage = "The quick brown fox jumps over seven lazy dogs while twelve green parrots sing in Strasse"
    chars = {"zero": "​", "soft": "­", "hyphen": "‐"}
    disguised = [
        passage.upper(),
        passage.replace(" ", "\n> **"),
        "".join(c + chars["zero"] for c in passage),
        passage.replace("quick", "qui-\n  ck").replace("parrots", "par" + chars["hyphen"] + "\r\nrots"),
        passage.replace("brown", "br" + chars["soft"] + "own").replace("green", "gr" + chars["soft"] + "\neen"),
        passage.translate({ord("a") + i: chr(0xFF41 + i) for i in range(26)}),  # full width
        passage.replace("Strasse", "Straße"),
        "intro; " + passage.replace(" ", "　") + "! end",
    ]
    docs = [(i, t, "", "") for i, t in enumerate(disguised)]
    plain = [(100, " ".join(passage.split()[:11]) + " then another", "", ""), (101, passage.replace("seven", "eight"), "", "")]
    a, b = spark.createDataFrame(docs + plain, DOC), spark.createDataFrame([(1, passage, "")], ITEM)
    assert rows(leaked_items(a, b)) == [(i, 1) for i in range(len(disguised))]


def test_very_long_text(spark, rows):
    words = [f"n{i}" for i in range(400_000)]
    item = " ".join(words[399_900:399_920])
    a, b = spark.createDataFrame([(1, " ".join(words), "", ""), (2, "a" * 3_000_000, "", "")], DOC), spark.createDataFrame([(7, item, "")], ITEM)
    assert rows(leaked_items(a, b)) == [(1, 7)]


def test_empty_tables(spark, rows):
    a, b = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    assert rows(leaked_items(a, b)) == []
    assert rows(leaked_items(a, spark.createDataFrame([(1, "a b c", "")], ITEM))) == []
    with pytest.raises(ValueError):
        leaked_items(a, b, min_run=3)
