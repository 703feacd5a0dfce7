"""Languages on held-out sentences."""

import itertools

import pandas as pd
import pytest

from tests.conftest import rows
from tidemill.llm import languages as L

PARTS = {
    "en": (["The neighbour", "My sister", "The old teacher", "Our friend"], ["bought a new house", "was looking for the keys", "wants to go home", "has not seen the film"], ["because the rain never stopped", "before the holidays began", "and nobody knew why", "while we were sleeping"]),
    "pt": (["O vizinho", "Minha irmã", "A velha professora", "Nosso amigo"], ["comprou uma casa nova", "estava procurando as chaves", "quer voltar para casa", "não viu o filme ainda"], ["porque a chuva não parou", "antes que começassem as férias", "e ninguém soube por quê", "enquanto nós dormíamos"]),
    "es": (["El vecino", "Mi hermana", "La vieja maestra", "Nuestro amigo"], ["compró una casa nueva", "estaba buscando las llaves", "quiere volver a casa", "todavía no vio la película"], ["porque la lluvia no paró", "antes de que empezaran las vacaciones", "y nadie supo por qué", "mientras nosotros dormíamos"]),
    "fr": (["Le voisin", "Ma sœur", "La vieille maîtresse", "Notre ami"], ["a acheté une nouvelle maison", "cherchait les clés", "veut rentrer chez lui", "n'a pas encore vu le film"], ["parce que la pluie ne cessait pas", "avant que les vacances commencent", "et personne ne savait pourquoi", "pendant que nous dormions"]),
    "de": (["Der Nachbar", "Meine Schwester", "Die alte Lehrerin", "Unser Freund"], ["kaufte ein neues Haus", "suchte die Schlüssel", "will nach Hause gehen", "hat den Film nicht gesehen"], ["weil der Regen nicht aufhörte", "bevor die Ferien begannen", "und niemand wusste warum", "während wir schliefen"]),
}


def sentences_of(language, held_out):
    every = list(itertools.product(*PARTS[language]))
    return [" ".join(p) + "." for k, p in enumerate(every) if (k % 5 == 0) == held_out]


@pytest.fixture(scope="module")
def net():
    rows_ = [(s, lang) for lang in PARTS for s in sentences_of(lang, False)]
    # One label of twenty is wrong.
    rows_ = [(s, "en" if k % 20 == 7 else lang) for k, (s, lang) in enumerate(rows_)]
    return L.train(pd.DataFrame(rows_ * 8, columns=["text", "language"]))


def test_held_out_accuracy(net):
    texts = [(s, lang) for lang in PARTS for s in sentences_of(lang, True)]
    x, owners = L.windows([s.lower() for s, _ in texts])
    best = net.log_probabilities(x).argmax(1)
    assert (best == [L.LANGUAGES.index(texts[o][1]) for o in owners]).mean() > 0.95


def test_mixed_wrong_and_right_labels(spark, net):
    one = lambda lang: " ".join(sentences_of(lang, True)[:4])
    docs = [(1, one("en"), "EN", 0), (2, one("pt"), "pt-BR", 0), (3, one("de"), "fr", 0), (4, one("es"), None, 0), (5, one("fr") + "\n" + one("de").upper(), "fr", 0), (6, "", "en", 0), (7, None, None, 0), (8, "12:30 !!", "??", 0), (9, "ok", None, 0), (10, one("en") * 300, "en_GB", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, segment int")
    segments = L.document_segments(df, "doc_id", "text", net).cache()
    found = rows(L.wrong_labels(df, segments, "doc_id", "lang"), "doc_id", "language")
    assert [f for f in found if f[0] != 9] == [(3, "de"), (4, "es"), (5, "de"), (5, "fr")]
    assert rows(segments.filter("doc_id = 5"), "segment", "language") == [(0, "fr"), (1, "de")]
    assert segments.filter("doc_id IN (6, 7, 8)").count() == 0
    assert all(0 < r[0] <= 1 for r in segments.select("confidence").collect())
    whole = segments.filter("doc_id = 10").first()
    assert whole["end_char"] == len(docs[-1][1])


def test_labels(spark):
    df = spark.createDataFrame([("EN",), ("en-US",), ("pt_PT",), (" de ",), ("xx",), ("und",), ("",), (None,), ("english",)], "l string")
    assert [r[0] for r in df.select(L.label_language(df.l)).collect()] == ["en", "en", "pt", "de", None, None, None, None, None]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    sample = L.labelled_sample(df, "doc_id", "text", "lang")
    assert len(sample) == 0 and L.train(sample) is None
    assert L.document_segments(df, "doc_id", "text", None).count() == 0


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(k, f"text {k}", "en" if k % 2 else "pt-BR") for k in range(400)], "doc_id long, text string, lang string")
    sample = L.labelled_sample(df, "doc_id", "text", "lang", 30)
    assert 10 <= len(sample) <= 60 and set(sample["language"]) == {"en", "pt"}


def test_phrases():
    many = L.Phrases([f"genre {k}" for k in range(1500)] + ["Música Lenta", "r&b", "hip-hop"])
    assert many.blank("some genre 1499, MUSICA LENTA and R & B or hip-hop.").split() == ["some", ",", "and", "or", "."]
    assert many.blank("genre x") == "genre x" and L.Phrases([]).blank("any text") == "any text"
