import random

import pytest

from chronoloom.llm import severity as S
from chronoloom.llm import severity_seeds as seeds


@pytest.fixture(scope="module")
def scorer():
    return S.train([s for t in ("Fuel on blocks 4130 kg.", "Gate 18 is blocked, use 21.", "Crew legal until 18:08.", "My bag arrived five days later.", "The seat was broken and nobody came.") * 30 for s in S.windows(S.plain_words(t))])


def test_held_out_sentences(scorer):
    """Sentences composed with another seed, which share words and templates but not their combinations."""
    rng = random.Random(99)
    rows = list(seeds.sentences(rng, 2))
    hit = [scorer.text(t) >= S.THRESHOLD for _, t in rows]
    bad = [h for h, (g, _) in zip(hit, rows) if g]
    good = [h for h, (g, _) in zip(hit, rows) if not g]
    assert sum(bad) / len(bad) > 0.97 and sum(good) / len(good) < 0.03


def test_grades_are_ordered(scorer):
    mild, severe = "You stupid idiot.", "I will find you after shift and break your jaw."
    assert 0.2 < scorer.text(mild) < scorer.text(severe) <= 3


@pytest.mark.parametrize("text", ["Y0u $tup1d 1d10t", "you s.t.u.p.i.d. i.d.i.o.t.", "YOU STUPID IDIOOOOT", "you stupid i****", "y o u  s t u p i d  idiot", "you stu pid id iot, shut your mouth", "yоu stupid idiоt"])
def test_disguises(scorer, text):
    assert scorer.text(text) >= S.THRESHOLD


def test_empty_and_long(scorer):
    assert scorer.text(None) == scorer.text("") == scorer.text("  \n ") == 0
    calm = "Fuel on blocks 4130 kg. " * 5000
    assert scorer.text(calm) < S.THRESHOLD < scorer.text(calm + "I will kill you, idiot. " + calm)
    assert scorer.text("x" * 100_000) < S.THRESHOLD


def test_documents(spark):
    rows = [(1, "Fuel on blocks 4130 kg.", "a"), (2, "You stupid idiot.", "b"), (3, None, "a"), (4, "", "b"), (2, "You stupid idiot.", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = S.score_documents(df, "doc_id", "text", "source").collect()
    assert len(got) == 5 and {r.doc_id for r in got if r.severity >= S.THRESHOLD} == {2}
    assert S.score_documents(df.limit(0), "doc_id", "text", "source").count() == 0


def test_templates_that_were_not_trained_on():
    """A fifth of the templates is left out of the training; most of what is composed from them is reported all the same."""
    templates = list(seeds.TEMPLATES)
    random.Random(3).shuffle(templates)
    scorer = S.train([], templates[len(templates) // 5 :])
    rows = [(g, t) for g, t in seeds.sentences(random.Random(4), 3, templates[: len(templates) // 5]) if g]
    assert sum(scorer.text(t) >= S.THRESHOLD for _, t in rows) / len(rows) > 0.85


def test_sentences_of_a_batch_score_as_alone(scorer):
    texts = ["You stupid idiot. Fuel on blocks 4130 kg.", None, "", "I will kill you.", "You stupid idiot. Fuel on blocks 4130 kg.", "word " * 50 + "you stupid idiot " + "word " * 50]
    together = scorer.texts(texts)
    assert [round(float(x), 9) for x in together] == [round(scorer.text(t), 9) for t in texts] and together[0] == together[4] and together[5] >= S.THRESHOLD


@pytest.mark.parametrize("text", ["The baby screamed the whole night.", "The radio died, so we came by bus.", "Der Schwanz der Katze ist verletzt.", "Je déteste cette file d'attente.", "Odio este ruido, de verdad."])
def test_harmless_uses(scorer, text):
    """Words of abuse, or hate of things, in sentences that attack nobody."""
    assert scorer.text(text) < S.THRESHOLD


def test_sample_counts_documents(spark):
    """A window comes once for each document that holds it, however often that does, as what is common is judged otherwise."""
    df = spark.createDataFrame([(i, "Fuel on blocks. Fuel on blocks. Gate closed.") for i in range(3)] + [(3, "Gate closed.")], "doc_id long, text string")
    assert S.corpus_sample(df, "doc_id", "text", 100, 12) == [["fuel", "on", "blocks"]] * 3 + [["gate", "closed"]] * 4
