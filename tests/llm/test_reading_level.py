import random

from medlattice.llm.reading_level import BANDS, TOLERANCE, prose_words, reading_levels

_FRAMES = {
    "easy": "You can ask mum for a big red cup. We all get sad some days. My cat has a soft bed at home.".split(". "),
    "plain": "Your doctor may ask you to keep a list of medicines. Most people feel better within a few weeks of treatment. The leaflet explains what happens at the clinic.".split(". "),
    "skilled": "Monitor the patient for signs of dehydration and record fluid balance. The nurse should check the infusion rate before handover. Assess the wound and document the dressing change.".split(". "),
    "expert": "Transcriptomic profiling revealed dysregulated histone deacetylation. Immunohistochemical quantification correlated inversely with podocyte effacement. Sensitivity analyses yielded concordant hazard estimates.".split(". "),
}


def text(band, seed, n=9):
    rng = random.Random(f"{band}{seed}")
    return ". ".join(
        f"{rng.choice(_FRAMES[band])} {rng.choice(['and', 'but', 'so'])} the {rng.choice(['one', 'two', 'next', 'same'])} is {rng.choice(['here', 'there', 'known'])}" for _ in range(n)
    ) + "."


def test_prose():
    assert len(prose_words(text("plain", 1))) >= 40
    assert prose_words(None) == prose_words("") == prose_words("too short") == []
    assert prose_words("Der Patient ist mit der Behandlung und den Tabletten nicht zufrieden, weil er sich nach dem Essen oft schlecht fühlt. " * 4) == []
    assert prose_words("sodium | 140 | mmol/L\npotassium | 4.1 | mmol/L\n" * 30) == []


def test_levels(spark):
    graded = [(i, b, text(b, i)) for b in BANDS for i in range(8)] + [(99, "odd", "x"), (98, "easy", None)]
    docs = [(f"{b}{i}", text(b, 1000 + i), "x") for b in BANDS for i in range(25)] + [
        ("null", None, "x"), ("stub", "See chart.", "x"), (None, text("easy", 5), "x"), ("long", text("expert", 7, 4000), "x")
    ]
    d = spark.createDataFrame(docs, "id string, t string, level string").repartition(3)
    g = spark.createDataFrame(graded, "item_id int, band string, text string")
    found = reading_levels(d, "id", "t", g)
    got = {r.doc_id: r for r in found.levels.collect()}
    assert set(got) == {i for i, _, _ in docs if i not in (None, "null", "stub")}
    assert all(r.band == i.rstrip("0123456789") for i, r in got.items() if i != "long") and got["long"].band == "expert"
    assert found.change <= TOLERANCE and 2 < found.rounds < 40
    for share in (0.0, 0.05):  # all words that two documents hold, or only frequent ones
        other = {r.doc_id: r for r in reading_levels(d, "id", "t", g, share=share).levels.collect()}
        assert all(other[i].band == r.band for i, r in got.items())
    further = {r.doc_id: r for r in reading_levels(d, "id", "t", g, tolerance=1e-6).levels.collect()}
    assert all(abs(further[i].level - r.level) < 0.02 for i, r in got.items())  # settled: more rounds hardly move a level
    spread_out = {r.doc_id: r for r in reading_levels(d.repartition(7), "id", "t", g).levels.collect()}
    assert all(abs(spread_out[i].level - r.level) < 1e-3 for i, r in got.items())
    assert reading_levels(d.limit(0), "id", "t", g).levels.count() == 0 and reading_levels(d, "id", "t", g.limit(0)).levels.count() == 0
    assert reading_levels(d, "id", "t", g.where("item_id = 3")).levels.count() == len(got)
