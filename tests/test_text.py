"""Normaliser, card tokeniser, type parser and small scalar functions."""

import pytest
from pyspark.sql import functions as F

from cardloom.functions.card_tokens import TokenOptions, card_tokens
from cardloom.functions.common import clean_strings, json_text, round_half_even, strip
from cardloom.functions.rules_text import NormalizeOptions, normalize_rules_text
from cardloom.functions.type_line import over_faces, type_faces
from cardloom.functions.words import gram_runs, ngrams, word_tokens


def run(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()


NORMAL = [
    ("Fire: Fire deals 2 damage. Fireball", "Fire", "this card: this card deals 2 damage. Fireball"),
    ("x", None, "x"),
    (None, "x", ""),
    ("   ", "x", ""),
    ("a\r\nb\r\r\r\rc", None, "a\nb\n\nc"),
    ("a \t b", None, "a b"),
    ("  a  \n  b  ", None, "a\nb"),
    ("A.B and AxB", "A.B", "this card and AxB"),
    ("fire Fire", "Fire", "fire this card"),
    ("text here", "   ", "text here"),
    ("éFire Fire_ Fire", "Fire", "éFire Fire_ this card"),
    ("Q\\E\\Q end", "Q\\E\\Q", "this card end"),
    ("pay $1 Cost", "Cost", "pay $1 this card"),
    ("Fire,Fire Fire", " Fire ", "this card,this card this card"),
]


def test_normalize(spark):
    rows = [(t, n) for t, n, _ in NORMAL]
    got = run(spark, rows, "t string, n string", out=normalize_rules_text(F.col("t"), F.col("n")))
    assert [r.out for r in got] == [w for _, _, w in NORMAL]


def test_normalize_options(spark):
    column = normalize_rules_text(
        F.col("t"), F.col("n"), NormalizeOptions(strip_reminder_text=True, replace_card_name=False)
    )
    rows = [("Flying (over\nlines) Bob (x)y", "Bob"), ("(gone)", None)]
    assert [r.out for r in run(spark, rows, "t string, n string", out=column)] == ["Flying Bob y", ""]


TOKENS = [
    ("Draw a card.\nAdd {G}. Pay 2 life.",
     ["draw_a_card", "NEWLINE", "add", "MANA:{G}", "pay", "NUM:2", "life"]),
    ("gets +1/+1", ["gets", "COUNTER:+1/+1"]),
    ("gets -1/-1, -10/-1", ["gets", "COUNTER:-1/-1", "-10/-1"]),
    ("a 2/2", ["a", "2/2"]),
    ("{g}{2/w}.", ["MANA:{G}", "MANA:{2/W}"]),
    ("a\n\nb", ["a", "NEWLINE", "b"]),
    ("a\n...\nb", ["a", "NEWLINE", "NEWLINE", "b"]),
    ("a\n...\n", ["a"]),
    ("\n\na", ["a"]),
    ("...", []),
    ("", []),
    (None, []),
    ("tab\there don't (stay)", ["tab\there", "don't", "(stay)"]),
    ("x{t}y {} {open", ["x", "MANA:{T}", "y", "{}", "{open"]),
    ("{a.b} {a{b}c", ["MANA:{A.B}", "MANA:{A{B}", "c"]),
    ("Target Creature you mayor you may", ["target_creature", "you", "mayor", "you_may"]),
    ("étarget creature", ["étarget", "creature"]),
    ("at the beginning of until end of turn", ["at_the_beginning_of", "until_end_of_turn"]),
    ("٣ 12 1a", ["NUM:٣", "NUM:12", "1a"]),
    ("mana_symbol", ["mana_symbol"]),
]


def test_card_tokens(spark):
    got = run(spark, [(t,) for t, _ in TOKENS], "t string", out=card_tokens(F.col("t")))
    assert [r.out for r in got] == [w for _, w in TOKENS]


def test_card_token_options(spark):
    keep_case = card_tokens(F.col("t"), TokenOptions(lowercase=False, keep_newlines=False))
    got = run(spark, [("Draw A Card.\nYou May Go",)], "t string", out=keep_case)
    assert got[0].out == ["draw_a_card", "you_may", "Go"]


def test_long_token(spark):
    got = run(spark, [("x" * 200_000 + " {g}",)], "t string", out=F.size(card_tokens(F.col("t"))))
    assert got[0].out == 2


TYPES = [
    ("Legendary Creature — Human Soldier", ["Creature"], ["Legendary"], ["Human", "Soldier"], 1),
    ("Creature — Elf // Sorcery", ["Creature", "Sorcery"], [], ["Elf"], 2),
    ("Creature-Elf", ["Creature"], [], ["Elf"], 1),
    ("Basic Land - Forest", ["Land"], ["Basic"], ["Forest"], 1),
    ("Artifact — Power-Plant - X", ["Artifact"], [], ["Power-Plant", "-", "X"], 1),
    ("Basic  Snow Land", ["Land"], ["Basic", "Snow"], [], 1),
    ("Creature — Elf — Orc", ["Creature"], [], ["Elf", "—", "Orc"], 1),
    (" ", [], [], [], 1),
    ("", [], [], [], 0),
    (None, [], [], [], 0),
]


def test_type_line(spark):
    faces = type_faces(F.col("t"))
    got = run(
        spark, [(t[0],) for t in TYPES], "t string",
        basic=over_faces(faces, "basic_types"), sup=over_faces(faces, "super_types"),
        sub=over_faces(faces, "sub_types"), n=F.size(faces), faces=faces,
    )
    assert [(r.basic, r.sup, r.sub, r.n) for r in got] == [t[1:] for t in TYPES]
    assert [f.raw_face_type_line for f in got[1].faces] == ["Creature — Elf", "Sorcery"]


def test_words_and_grams(spark):
    got = run(
        spark, [("Éa b_c x²!\nD",), (None,), ("one",)], "t string",
        words=word_tokens(F.col("t")), grams=ngrams(word_tokens(F.col("t"))),
        tri=ngrams(word_tokens(F.col("t")), 2, 3),
    )
    assert got[0].words == ["éa", "b_c", "x²", "d"]
    assert got[0].grams == ["éa", "b_c", "x²", "d", "éa b_c", "b_c x²", "x² d"]
    assert got[0].tri == ["éa b_c", "b_c x²", "x² d", "éa b_c x²", "b_c x² d"]
    assert (got[1].words, got[1].grams, got[2].grams, got[2].tri) == ([], [], ["one"], [])


def test_gram_runs(spark):
    got = run(spark, [(["b", "a", "b", "b"],), ([],)], "g array<string>", out=gram_runs(F.col("g")))
    assert [(r.term, r.opens) for r in got[0].out] == [("a", 1), ("b", 1), ("b", 0), ("b", 0)]
    assert got[1].out == []


def test_small_scalars(spark):
    got = run(
        spark, [(["a", None, ""], 2.5, "\x1c　 a b\x85"), (None, 3.5, "\t")],
        "l array<string>, x double, s string",
        clean=clean_strings(F.col("l")), whole=round_half_even(F.col("x")), bare=strip(F.col("s")),
        text=json_text(F.struct("l", F.lit(None).cast("int").alias("n"))),
    )
    assert [r.clean for r in got] == [["a", ""], []]
    assert [r.whole for r in got] == [2.0, 4.0]
    assert [r.bare for r in got] == ["a b", ""]
    assert got[1].text == '{"l":null,"n":null}'


@pytest.mark.parametrize("text", ["a" * 50_000, " \t" * 20_000 + "a", "{" * 5_000 + "a"])
def test_hostile_texts_finish(spark, text):
    got = run(
        spark, [(text,)], "t string",
        norm=normalize_rules_text(F.col("t"), F.lit("a")), tokens=F.size(card_tokens(F.col("t"))),
    )
    assert got[0].tokens == 1
