"""Rule table: one text for and one against each label, ranking, fallback, hints."""

from dataclasses import replace

from pyspark.sql import functions as F

from cardloom.functions.label_rules import RULES, TAXONOMY
from cardloom.functions.labels import fold_letters, labels_of, ranked_rules, rule_hits
from cardloom.operators.labelling import (
    best_match_per_label,
    card_labels,
    label_names,
    label_summary,
    labels_long,
    primary_label_counts,
    taxonomy,
)
from cardloom.plans.demo_cards import TEMPLATES, documents

# label, types, a text it applies to, a text it does not apply to
CASES = [
    ("vanilla_creature", ["Creature"], " \n", "x"),
    ("french_vanilla_creature", ["Creature"], "flying, haste", "flying: draw"),
    ("land_ramp", [], "Search your library for a basic land", "search your library\nfor a x land"),
    ("mana_dork", ["Creature"], "{t}: add {g}", "madd {g}"),
    ("mana_rock", ["Artifact"], "add one mana", "add one\nmana"),
    ("ritual", ["Instant"], "add an amount of mana", "add an amount of manas"),
    ("cost_reducer", [], "spells cost {2} less to cast", "costs {x} less to cast"),
    ("card_draw", [], "draw 12 cards", "draw five cards"),
    ("impulse_draw", [], "exile the top card of your library. you may play it", "exile the top of library"),
    ("loot", [], "draw a card, then discard", "draw a card.\ndiscard"),
    ("rummage", [], "discard a card then draw", "discard.\ndraw"),
    ("targeted_removal_destroy", [], "Destroy target x", "destroy targets"),
    ("targeted_removal_exile", [], "exile target x", "reexile target x"),
    ("targeted_removal_bounce", [], "return target x to its owner's hand", "return target x to their hand"),
    ("counterspell", [], "counter target activated ability", "counter target card"),
    ("board_wipe", [], "all creatures", "all creature"),
    ("pump_spell", [], "target creature gets +1/+2", "target creature gets 1/2"),
    ("debuff_spell", [], "it gets -1/-1 until end of turn", "it gets -1/-1 for good"),
    ("anthem", [], "creatures you control get +1/+1", "creatures you control get tall"),
    ("token_maker", [], "create a map", "create a\nmap"),
    ("sac_outlet", [], "sacrifice two: x", "sacrifice two"),
    ("sac_payoff", [], "whenever a creature dies", "when a creature dies"),
    ("discard_outlet", [], "discard two cards: x", "discard two cards"),
    ("discard_payoff", [], "whenever a player discards", "whenever players discard"),
    ("mill", [], "mill two", "milled, éMILL, mill²"),
    ("graveyard_payoff", [], "threshold", "their graveyard"),
    ("reanimation", [], "return it from your graveyard to the battlefield", "return from your graveyard"),
    ("blink_enabler", [], "exile it, then return it to the battlefield", "exile it"),
    ("lifegain_payoff", [], "if you gained life", "you gain life"),
    ("group_hug_draw", [], "each opponent draws", "each opponent may draw"),
    ("group_hug_ramp", [], "each player may search for a land", "each player may\nsearch for a land"),
    ("tutor", [], "search your library for a card", "search your library for a basic land card"),
    ("stax_piece", [], "players can't", "players cannot"),
    ("protection", [], "protection from red", "protecting from red"),
]


def _labelled(spark, rows):
    frame = spark.createDataFrame(
        rows, "id string, oracle_text_norm string, basic_types array<string>"
    )
    return {r.id: r for r in card_labels(frame).collect()}


def test_each_label(spark):
    rows = []
    for label, types, yes, no in CASES:
        rows += [(label + "+", yes, types), (label + "-", no, types)]
    got = _labelled(spark, rows)
    assert [c[0] for c in CASES] == [r.label for r in RULES]
    for label, *_ in CASES:
        assert label in got[label + "+"].labels, label
        assert label not in got[label + "-"].labels, label


def test_ranking_and_fallback(spark):
    got = _labelled(
        spark,
        [
            ("tie", "Destroy target x. Exile target y. Draw a card.", ["Sorcery"]),
            ("mixed", "Threshold. Search your library for a basic land. Destroy target x.", None),
            ("none", "nothing here", ["Sorcery"]),
            ("null", None, None),
            ("blank", "", ["Creature"]),
        ],
    )
    assert got["tie"].labels == ["card_draw", "targeted_removal_destroy", "targeted_removal_exile"]
    assert got["mixed"].labels == ["land_ramp", "targeted_removal_destroy", "graveyard_payoff"]
    assert got["mixed"].primary_label == "land_ramp" and got["mixed"].max_confidence == 0.9
    for key in ("none", "null"):
        assert got[key].labels == ["needs_review"] and got[key].needs_review
        assert got[key].label_confidences == {"needs_review": 0.3}
    assert got["blank"].labels == ["vanilla_creature"] and not got["blank"].needs_review
    assert got["blank"].label_sources == {"vanilla_creature": "rule"}
    assert got["blank"].cluster is None


def test_text_choice_and_folded_letters(spark):
    frame = spark.createDataFrame(
        [("a", "", "Mill two"), ("b", "x", "Mill two"), ("c", "mıll two", None)],
        "id string, oracle_text_norm string, oracle_text string",
    ).withColumn("basic_types", F.array().cast("array<string>"))
    got = {r.id: r.labels for r in card_labels(frame).collect()}
    assert got == {"a": ["mill"], "b": ["needs_review"], "c": ["mill"]}


def test_hints_never_change_the_outcome(spark):
    plain = [replace(r, hints=()) for r in RULES]
    cases = spark.createDataFrame([(y,) for _, _, y, _ in CASES] + [(t,) for t in TEMPLATES], "t string")
    texts = cases.unionByName(documents(spark, "/root/testdata/sf0.001").select(F.col("text").alias("t")))
    text = F.lower("t")
    kinds = F.array(F.lit("creature"))
    quick = labels_of(rule_hits(text, fold_letters(text), kinds))
    full = labels_of(rule_hits(text, fold_letters(text), kinds, plain))
    assert texts.filter(quick != full).count() == 0


def test_long_form_and_best_match(spark):
    frame = spark.createDataFrame(
        [("a", "Destroy target x. Mill.", ["Sorcery"]), ("b", "zzz", [])],
        "id string, oracle_text_norm string, basic_types array<string>",
    )
    long = labels_long(frame)
    assert sorted((r.id, r.label_rank, r.label) for r in long.collect()) == [
        ("a", 1, "targeted_removal_destroy"), ("a", 2, "mill"), ("b", 1, "needs_review"),
    ]
    weaker = long.withColumn("confidence", F.lit(0.1)).withColumn("reason", F.lit("weak"))
    best = best_match_per_label(weaker, long).collect()
    assert len(best) == 3 and all(r.confidence > 0.1 and r.reason != "weak" for r in best)


def test_rules_and_taxonomy_agree(spark):
    assert {r.label for r in RULES} | {"needs_review"} == {t.label for t in TAXONOMY}
    assert label_names() == sorted(t.label for t in TAXONOMY)
    assert [r.label for r in taxonomy(spark).collect()] == label_names()
    confidences = [r.confidence for r in ranked_rules()]
    assert confidences == sorted(confidences, reverse=True)


def test_summary(spark):
    frame = spark.createDataFrame(
        [("a", "mill", []), ("b", "zzz", []), ("c", "mill", []), ("d", "mill", [])],
        "id string, oracle_text_norm string, basic_types array<string>",
    )
    clusters = spark.createDataFrame([("a", 1), ("b", 2)], "id string, cluster int")
    labels = card_labels(frame, clusters)
    row = label_summary(labels, clusters).first()
    assert (row.cards_labeled, row.primary_labels, row.review_share, row.clusters) == (4, 2, 0.25, 2)
    assert [(r.primary_label, r["count"]) for r in primary_label_counts(labels).collect()] == [
        ("mill", 3), ("needs_review", 1),
    ]
