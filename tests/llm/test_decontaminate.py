import random

from veilframe.llm import decontaminate as D


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def bits(pattern):
    out = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def test_myers():
    rng = random.Random(1)
    for _ in range(2000):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        assert D.myers(bits(p), len(p), t)[0] == distance(p, t)


def item(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at] = rng.choice(["", "z", out[at] + "z"])
    return "".join(out)


def test_items_within_their_budget_are_found():
    rng = random.Random(2)
    items = [(i, item(rng, rng.randint(10, 40))) for i in range(12)]
    finder = D.Finder(items, 0.08)
    for _ in range(150):
        number, text = rng.choice(items)
        near = edited(rng, text, rng.randint(0, int(0.12 * len(text))))
        document = f"{item(rng, rng.randint(0, 30))} {near.upper()}\n {item(rng, rng.randint(0, 30))}"
        found = {i: e for i, e, _, _ in finder.find(document)}
        want = {i: d for i, t in items if (d := distance(t, D.normal(document))) <= int(0.08 * len(t))}
        assert found == want


def test_place_in_words():
    text = "one two three four five six seven eight nine ten"
    assert D.Finder([(7, text)], 0.08).find("a b " + text + " c") == [(7, 0, 2, 12)]


def test_operator(frame):
    rng = random.Random(3)
    a, b = item(rng, 20), item(rng, 25)
    docs = frame([(1, "x " + a + " y", "k"), (2, None, "k"), (3, "", "k"), (4, a + " " + b, "k"), (4, a + " " + b, "k"), (None, b, None), (5, item(rng, 200), "k")],
                 "doc_id long, text string, item_id string")
    items = frame([(10, a, 1), (11, b, 1), (11, b, 1), (12, None, 1), (13, "", 1), (14, "short", 1), (None, a, 1)], "item_id long, text string, leaks int")
    want = [(1, 10), (4, 10), (4, 10), (4, 11), (4, 11), (None, 11)]
    for block in (4_000_000, 50):  # all items in one pass, or one pass per item
        out = D.leaks(docs, items, block_chars=block)
        assert sorted(((r.doc_id, r.item_id) for r in out.collect()), key=str) == sorted(want, key=str)
    kept = D.find_items(docs, items, into="item_id").where("size(item_id) = 0")
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()}
    exact = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect()
             if len(D.normal(i.text)) >= 32 and D.normal(i.text) in D.normal(d.text)}
    assert exact <= found


def test_short_items_are_whole_words(frame):
    items = [(1, "Two words"), (2, "seven"), (3, "a"), (4, "é? ")]
    finder = D.Finder([(i, D.normal(t)) for i, t in items], 0.08)
    for text, want in {"two  WORDS": {1}, "two wordsmith": set(), "eleven seven": {2}, "seventy-seven": set(), "b a": {3}, "ba ab": set(), "é? é": {4}, "é?x": set(),
                       "x two\nwords a": {1, 3}, "two two words": {1}, "": set()}.items():
        assert {i for i, *_ in finder.find(text)} == want, text
        assert all(e == 0 for _, e, _, _ in finder.find(text))
    assert finder.find("one two words here") == [(1, 0, 1, 3)]
    docs = frame([(1, "say two words"), (2, "nothing")], "doc_id long, text string")
    out = D.leaks(docs, frame([*items, (5, " "), (6, None)], "item_id long, text string"))
    assert [tuple(r)[:2] for r in out.collect()] == [(1, 1)]


def test_letters_alone_lose_no_place():
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice(["ab", "ba", "aab", "bba"]) for _ in range(14))) for i in range(4)]
    finder = D.Finder(items, 0.12)
    for _ in range(60):
        document = " ".join(rng.choice(["ab", "ba", "aab", "bba"]) for _ in range(60)) + " " + edited(rng, rng.choice(items)[1], rng.randint(0, 6))
        want = {i: d for i, t in items if (d := distance(t, D.normal(document))) <= int(0.12 * len(t))}
        assert {i: e for i, e, _, _ in finder.find(document)} == want
