import unicodedata

import pytest

from siltstone.llm import lookalikes

LATIN = "The people of Moscow hope to cope with a comma"
DOCS = [
    (1, LATIN), (2, LATIN), (3, LATIN.replace("o", "о").replace("c", "с")), (4, "​The peo­ple" + LATIN[10:]), (5, LATIN.replace(" ", " ")),
    (6, "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in LATIN)), (7, LATIN.lower()), (8, LATIN.replace("v", "ν").replace("o", "ο")),
    (9, "café 12"), (10, unicodedata.normalize("NFD", "café 12")), (11, "cafe 12"), (12, "café 1²"), (13, "café １２"), (14, "café ①2"),
    (15, "Мы сравнили сорок с лишним опросов"), (16, "Мы cpaвнили copoк c лишним oпpocoв"), (17, ""), (18, "​"), (19, None), (20, "ﬁnal 40 Å"), (21, "final 40 Å"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "clash") for d in DOCS], "doc_id long, text string, form string").repartition(3)


def test_pairs(docs):
    got = {(r.doc_a, r.doc_b) for r in lookalikes.lookalike_pairs(docs).collect()}
    group = [1, 2, 3, 4, 5, 6, 8]
    want = {(a, b) for a in group for b in group if a < b} - {(1, 2)}
    assert got == want | {(9, 10), (9, 13), (10, 13), (15, 16), (17, 18), (20, 21)}


def test_one_form_is_in_the_script_of_the_text(docs):
    scores = lookalikes.log_scores(lookalikes.learn_bigrams(docs))
    got = {r.doc_id: r.canonical for r in lookalikes.unify_texts(docs, scores).collect()}
    assert got[3] == got[6] == got[8] == LATIN and got[16] == got[15] == DOCS[14][1] and got[21] == "final 40 Å"
    assert 19 not in got and got[18] == ""
    again = lookalikes.Unifier(scores)
    assert all(again.unify(t) == t for t in got.values())


def test_empty(docs):
    assert lookalikes.lookalike_pairs(docs.limit(0)).count() == 0


def folded(text):
    """Brute force: every letter by the first letter of its class, accents apart."""
    plain = lookalikes.decomposed(text, lookalikes._Looks())
    return unicodedata.normalize("NFC", "".join(lookalikes._CLASSES.get(c, (c,))[0] for c in plain))


def pairs_by(rows, form):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(form(text), []).append((doc_id, text))
    return {(min(a[0], b[0]), max(a[0], b[0])) for g in groups.values() for a in g for b in g if a[1] != b[1]}


def test_pairs_equal_brute_force_by_shape(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").where("text is not null").collect()]
    assert {tuple(r) for r in lookalikes.p8_found(spark, tiny).collect()} == pairs_by(rows, folded)


def test_pairs_are_lost_without_the_search(docs, monkeypatch):
    scores = lookalikes.log_scores(lookalikes.learn_bigrams(docs))
    rows = [d for d in DOCS if d[1] is not None]
    found = pairs_by(rows, lambda t: lookalikes.Unifier(scores).unify(t))
    monkeypatch.setattr(lookalikes, "best_path", lambda token, *_: token)
    lost = found - pairs_by(rows, lambda t: lookalikes.Unifier(scores).unify(t))
    assert (1, 3) in lost and (2, 8) in lost and (15, 16) in lost


def test_accented_letters_of_equal_shape():
    unifier = lookalikes.Unifier(lookalikes.log_scores({(0, "^", "n"): 9, (2, "^", "е"): 9}))
    for a, b in (("naïve Noël", "naїve Noёl"), ("Её ёлка", "Eё ëлкa"), ("Кόσμος κόσμε", "Kόσμος κόσμε")):
        assert a != b and unifier.unify(a) == unifier.unify(b) and unicodedata.is_normalized("NFC", unifier.unify(a))
    assert unifier.unify("Noel") != unifier.unify("Noël")
    assert unifier.unify("cop") == unifier.unify("сор") and unifier.unify("1 2") == "1 2"


def test_classes(docs):
    got = {r.doc_id: (r.class_id, r.n_docs, r.n_texts) for r in lookalikes.lookalike_classes(docs).collect()}
    assert got[8] == (1, 7, 6) and got[13] == (9, 3, 3) and got[7] == (7, 1, 1) and 19 not in got


def test_long_text_and_viterbi():
    scores = lookalikes.log_scores({(0, "^", "c"): 9, (0, "c", "o"): 9, (0, "o", "p"): 9, (0, "p", "$"): 9, (2, "^", "с"): 9, (2, "с", "о"): 9, (2, "о", "р"): 9, (2, "р", "$"): 9})
    assert lookalikes.best_path("cop", scores, (0.0, -14.0, -14.0, -14.0)) == "cop" and lookalikes.best_path("cop", scores, (-14.0, -14.0, 0.0, -14.0)) == "сор"
    text = "сору " * 50_000
    assert lookalikes.Unifier(scores).unify(text) == lookalikes.Unifier(scores).unify(text.replace("о", "o"))
