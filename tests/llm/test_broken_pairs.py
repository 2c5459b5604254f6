import pytest
from medlattice.llm.broken_pairs import broken_pairs, copies, is_empty, left_open, list_short, other_language, tile
from medlattice.llm.refusals import is_refusal

Q = "Which tests confirm asthma before the drug is given?"


@pytest.mark.parametrize("x", [None, "", " \n", "​\xa0", "...", "<p></p>", "**", "N/A", "answer: n/a", "Answer:", "null", "TBD", "A: ", "```\n```", "{}"])
def test_empty(x):
    assert is_empty(x)


@pytest.mark.parametrize("x", ["no.", "7", "Yes", "[12]", "A", "None of the tests helps."])
def test_not_empty(x):
    assert not is_empty(x) or x == "A"


def test_tiles_are_greedy_and_unmarked():
    assert tile("a b c d e".split(), "x a b c y d e".split()) == [(0, 1, 3), (3, 5, 2)]
    assert tile(["a"], ["a"]) == [] and tile([], ["a"]) == []


def test_copies():
    assert copies(Q, Q.upper()) and copies(Q, f"You asked: {Q}") and copies(Q, f"{Q} {Q}") and copies(
        Q, "Which tests really confirm asthma before the drug is given"
    )
    assert copies("Which signs point to gout in older adults?", "In older adults, which signs point to gout?")
    assert not copies(
        Q, f"You asked: {Q} In short: spirometry with a bronchodilator shows a clear rise in flow."
    ) and not copies(Q, "Asthma") and not copies("", "x")


@pytest.mark.parametrize("x", ["I'm sorry, but I can't help with that.", "Questions of this kind are not handled by this service.", "Es tut mir leid, dazu kann ich nichts sagen.", "As a language tool, I won't comment on treatment choices. Please ask your doctor.", "Lo siento, no puedo responder a eso.", "Je ne peux pas répondre à cette question."])
def test_refusals(x):
    assert is_refusal(x)


@pytest.mark.parametrize("x", ["I am sorry to hear of the delay. Spirometry confirms asthma.", "People who cannot take it are given another drug.", "Unfortunately, relapse is common. Dose is 5 mg.", "It should not be used in pregnancy."])
def test_no_refusals(x):
    assert not is_refusal(x)


def test_length_decides_nothing():
    assert all(copies(Q, " ".join([Q] * n)) for n in (3, 4, 9, 3000)) and copies(Q, "Asked: " + "Which tests confirm asthma before the drug? " * 12)
    assert not copies(Q, " ".join([Q] * 9) + " Spirometry with a bronchodilator shows a clear rise in flow.")
    assert is_refusal("I can't advise on 20 mg of aspirin.") and is_refusal("I can't help with that. " * 60)
    assert is_refusal(
        "I can't give advice on that, " + "whatever the reason for asking may be and however the question is put, " * 5 + "and I am sorry for it."
    )
    assert is_refusal("Although I would like to help, I can't answer that.") and is_refusal("I'd like to help, but I can't advise on 20 mg of it.")


@pytest.mark.parametrize("x", ["I can't give personal advice, but the usual dose is 20 mg twice a day.", "While I can't advise you personally, the usual dose is 20 mg.", "Doses of 20 mg are outside the guidelines.", "I can't advise on that. " * 40 + "Take 20 mg."])
def test_what_tells_something_is_no_refusal(x):
    assert not is_refusal(x)


def test_refusals_of_other_wording():
    """32 of 40 were found, and none of the sound ones, when these were first tried; the rules were widened after that."""
    from wordings import REFUSALS, SOUND

    assert sum(is_refusal(x, "What is the right dose?") for x in REFUSALS) >= 38
    assert sum(is_refusal(x, "What is the right dose?") for x in SOUND) == 0


def test_languages_beyond_the_common_ones():
    assert other_language(Q, "Läkemedlet ska inte tas före operationen om man har feber.") and other_language(
        Q, "Lek nie powinien być stosowany przed posiłkiem, jeśli jest gorączka."
    )
    assert other_language(Q, "İlaç günde bir kez alınır ve tedavi sonra daha kısa olabilir.") and other_language(
        "Hur tas läkemedlet och när?", "The drug is taken with a meal in the morning."
    )
    assert not other_language("Hur ska det tas och när?", "Det tas med mat för att det inte ska göra ont.")


def test_lists():
    assert list_short("Do these four things:\n1. Rest.\n2. Drink.") and list_short("Three signs:\n- pain\n  - at night\n- fever")
    assert not list_short("Two signs:\n- pain\n- fever") and not list_short("1. Rest.\n2. Drink.") and not list_short("Four drugs:\n- a\n- b\nThese are known.")


def test_other_language():
    assert other_language(Q, "Die Behandlung lindert den Schmerz und verbessert die Funktion der Niere.")
    assert other_language(Q, "Answer: 该药可以减轻疼痛并改善肾功能。") and other_language("¿Qué efectos tiene el fármaco?", "The most common effects are nausea and fatigue.")
    assert not other_language(
        Q, 'The leaflet says "tomar con comida", which means to take it with food.'
    ) and not other_language(Q, "Amoxicillin") and not other_language("Was ist die Dosis?", "Die übliche Dosis ist 5 mg pro Tag.")


def test_pushdown_parser():
    assert left_open("a (b") and left_open('he said "x') and left_open("```py\nx") and left_open("<b>x") and left_open("[a {b]")
    assert not left_open("a (b) [c] \"d\" `e` ```f(``` <br> <b>x</b>") and not left_open(")") and not left_open("")


def test_table(spark):
    whole = [
        f"Relapse of gout is linked to missed doses and {w}." for w in ("coughing", "driving", "running")
    ] * 4 + ["Use it with care in adults, since pain may occur."] * 4 + ["1. fever\n2. pain\n3. fever."]
    rows = [(i, Q, a, 0) for i, a in enumerate(whole)]
    odd = {
        100: (None, "empty"), 101: ("", "empty"), 102: (Q, "copies_question"), 103: ("I can't help with that.", "refusal"), 104: ("Les études montrent une amélioration chez les personnes âgées.", "other_language"),
        105: ("Use it with care in", "truncated"), 106: ("Relapse of gout is linked to missed doses and cou", "truncated"), 107: ("Relapse of gout is linked to missed doses and driving", None), 108: ("1. pain\n2. fever", None), 109: ("1. pain\n2.", "truncated"),
        110: ("Use it (for example", "truncated"), 111: ("Yes", None), 112: ("word " * 40_000 + "end.", None), 113: ("Relapse of gout is linked to missed doses, which", "truncated"),
    }
    rows += [(i, Q, a, 0) for i, (a, _) in odd.items()] + [(102, Q, Q, 1), (None, Q, None, 0), (114, None, "Rest helps most people.", 0)]
    df = spark.createDataFrame(rows, "id long, q string, a string, defect int")
    got = {r.item_id: r.defect for r in broken_pairs(df, "id", "q", "a").collect()}
    assert got == {i: d for i, (_, d) in odd.items() if d}
    assert broken_pairs(df.limit(0), "id", "q", "a").count() == 0


@pytest.mark.parametrize("n", [2, 3, 60])
def test_copies_of_a_cut_answer_make_it_no_phrase(spark, n):
    rows = [(i, f"{Q} {i}", "The usual starting dose is") for i in range(n)] + [(1000 + i, f"{Q} {i}", "The usual starting dose is 5 mg.") for i in range(4)]
    rows += [(2000 + i, Q, "Use it with cau") for i in range(n)] + [(3000 + i, f"How often is drug {chr(97 + i % 26)} taken?", "Twice dayly") for i in range(n)]
    got = {r.item_id: r.defect for r in broken_pairs(spark.createDataFrame(rows, "id long, q string, a string"), "id", "q", "a").collect()}
    assert got == {i: "truncated" for i in [*range(n), *range(2000, 2000 + n)]}
