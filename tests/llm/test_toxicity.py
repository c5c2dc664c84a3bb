import pytest

from veilframe.llm import toxicity as T
from veilframe.llm.labels import labelled_sample
from veilframe.llm.queries import held_out
from pyspark.sql import functions as F

LEXICON = T.Lexicon({" idiot ": 4.0, " stup": 3.0}, ("idiot savant",), 4.0, 0.5)


def weight(text):
    return T.Matcher(LEXICON).measure(text)[0]


@pytest.mark.parametrize(("text", "total"), [
    ("you idiot", 4.0), ("You IDIOT!", 4.0), ("id10t", 4.0), ("іdiоt", 4.0), ("1d!ot and st|pid", 4.0), ("$tupidity, stupid", 6.0), ("idiotic", 0.0),
    ("an idiot savant is", 0.0), ("idiot savant idiot", 4.0), ("costup", 0.0), ("", 0.0), (None, 0.0), ("ｉｄｉｏｔ", 4.0)])
def test_matching(text, total):
    assert weight(text) == total


def test_score_falls_with_length():
    m = T.Matcher(LEXICON)
    scores = [m.score("idiot " + "word " * n) for n in (0, 10, 100, 1000)]
    assert scores == sorted(scores, reverse=True) and scores[0] > 0.5 > scores[-1] >= 0
    assert m.score("") == m.score(None) < 0.5


def labelled(frame, n=60):
    rows = []
    for i in range(n):
        rows.append((f"you are such a plain trash bag and number{i} goes on", 0))
        rows.append((f"you are such a {'moron' if i % 2 else 'loweix' + chr(97 + i % 20)} and number{i} goes on", 1))
    return frame([*rows, (None, 0), ("x", None)], "text string, label int")


def test_learning(frame):
    lexicon = T.learn_lexicon(labelled(frame))
    assert any(t.startswith(" moro") for t in lexicon.terms) and any(t.startswith(" lowe") for t in lexicon.terms)
    m = T.Matcher(lexicon)
    assert m.score("what a moron") > 0.5 and m.score("a loweizz thing") > 0.5 and m.score("a plain trash bag") < 0.5
    assert T.Lexicon.from_json(lexicon.to_json()) == lexicon


def test_nothing_to_learn(frame):
    for rows in ([], [("a b", 0)], [("a b", None)]):
        lexicon = T.learn_lexicon(frame(rows, "text string, label int"))
        assert lexicon.terms == {} and T.Matcher(lexicon).score("you idiot") < 0.5


def test_scoring_odd_rows(frame):
    docs = frame([(1, "you idiot", 5), (2, None, 5), (3, "", 5), (None, "you idiot", None)], "doc_id long, text string, score int")
    out = {(r.doc_id): r.score for r in T.score_toxicity(docs, LEXICON).collect()}
    assert out[1] == out[None] > 0.5 > out[2] == out[3]
    assert T.score_toxicity(docs.limit(0), LEXICON).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    sample = labelled_sample(docs, labels, "toxic", learn=~held_out("doc_id", 5, 0), max_rows=4000)
    assert sample.count() <= 4000
    scored = T.score_toxicity(docs.join(labels.where(held_out("doc_id", 5, 0)), "doc_id"), T.learn_lexicon(sample))
    rows = scored.groupBy("toxic", (F.col("score") >= 0.5).alias("hit")).count().collect()
    n = {(r.toxic, r.hit): r["count"] for r in rows}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.85 and n.get((0, True), 0) / n[0, False] < 0.02


def plain_weight(text, lexicon):
    """The lexicon looked for at every place of a folded text, term by term."""
    plain = T.folded(text)
    safe = []
    for phrase in lexicon.exceptions:
        phrase, at = f" {phrase.strip()} ", -1
        while (at := plain.find(phrase, at + 1)) >= 0:
            safe.append((at, at + len(phrase) - 1))
    heaviest = {}
    for term, weight in lexicon.terms.items():
        at = -1
        while (at := plain.find(term, at + 1)) >= 0:
            if not any(a <= at < b for a, b in safe):
                heaviest[at] = max(weight, heaviest.get(at, 0))
    return sum(heaviest.values())


def test_whole_table_as_a_plain_search(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = T.learn_lexicon(labelled_sample(docs, labels, "toxic", learn=~held_out("doc_id", 5, 0), max_rows=2000))
    words = sorted({w for r in docs.limit(30).collect() for w in (r.text or "").split()[:40]})[::7]
    lexicon = T.Lexicon(learned.terms | {f" {T.folded(w).strip()} ": 1.5 for w in words} | {f" {T.folded(w).strip()[:3]}": 0.5 for w in words[::3]},
                        tuple(T.folded(" ".join(r.text.split()[3:5])).strip() for r in docs.limit(20).collect() if r.text), learned.scale, learned.middle)
    matcher, hits = T.Matcher(lexicon), 0
    scores = {r.doc_id: r.score for r in T.score_toxicity(docs, lexicon).collect()}
    for r in docs.collect():
        total = plain_weight(r.text, lexicon)
        hits += total > 0
        assert matcher.measure(r.text)[0] == pytest.approx(total)
        assert scores[r.doc_id] == pytest.approx(matcher.score(r.text))
    assert hits > 50
