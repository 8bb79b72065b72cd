"""Card-like rows derived from the ``part`` table.

The given tables hold no cards, so every part becomes one card: its key picks a
text template, its type a type line. The oracle SQL derives the same rows from the
same lists. In a template ``@`` stands for the card's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.sources.tables import read_table

TEMPLATES = (
    "",
    "Flying, vigilance",
    "Search your library for a basic land card, put that card onto the battlefield tapped.",
    "{T}: Add {G}.\n\n\n\nWhen @ enters the battlefield, you may draw a card.",
    "{2}, {T}: Add two mana of any one color. @ doesn't untap during your next untap step.",
    "Add {R}{R}{R}.\r\nSpells you cast cost {1} less this turn.",
    "Noncreature spells cost {1} less to cast.",
    "Draw three cards.",
    "Exile the top two cards of your library. Until end of turn, you may cast them.",
    "Draw two cards, then discard a card.",
    "Discard a card, then draw two cards.",
    "Destroy target artifact.\tIt can't be regenerated.",
    "Exile target enchantment (this includes auras).",
    "Return target permanent to its owner's hand.",
    "Counter target spell. @'s owner loses 2 life.",
    "Destroy all artifacts. Each creature loses flying.",
    "Target creature gets +3/+3 until end of turn.",
    "Up to one target creature gets -2/-2 until end of turn.",
    "Creatures you control get +1/+1.\nOther creatures you control get more, @s too.",
    "Create a 1/1 green Saproling token. (It's a creature.)",
    "{B}, Sacrifice another creature: You gain 1 life.",
    "Whenever another creature you control dies, put a +1/+1 counter on @.",
    "Discard a card: @ gains trample until end of turn.",
    "Whenever an opponent discards a card, that player loses 2 life.",
    "Target player puts the top four cards of their library into their graveyard. Mill two.",
    "Flashback {3}{U}\r\rYou may play lands from your graveyard.",
    "Return target creature card from your graveyard to the battlefield.",
    "Exile target creature you control, then return it to the battlefield under your control.",
    "Whenever you gain life, put a +1/+1 counter on @.\r\n",
    "At the beginning of each upkeep, each player draws a card.",
    "Each player may search their library for a basic land card.",
    "Search your library for an instant card, reveal it, and put it into your hand.",
    "Players can't search libraries.  @ can't attack.",
    "Creatures you control gain hexproof and indestructible until end of turn.",
    "   @: @ deals 2 damage to @@.   As long as @ is here, @, @ and (@) stay.  ",
    "Scry 2.",
    "...\n!?\nPrevent all damage.\n...",
    "Choose 12 or {X/2}{W/P}; then {unclosed brace and {C} end.",
    "First strike, ward {2}",
    "Gain 3 life. Target opponent may have you draw a card as long as you may.",
    "Equip {3}\nEquipped creature gets -1/-1 and has menace.",
    "Add one mana of any color.",
    "Nothing of note here; 7 of 7.",
)

# Type lines by part type: an em dash, hyphens, several faces, plain, odd spaces.
TYPE_LINES = {
    "STANDARD": "Legendary Creature — Elf Druid",
    "ECONOMY": "Artifact - Equipment",
    "MEDIUM": "Creature-Soldier",
    "SMALL": "Creature — Human  Wizard // Sorcery — Arcane",
    "LARGE": "Basic  Snow Land",
}


def read_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/part.parquet")


def demo_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core card rows; the columns no query needs are left out on purpose."""
    key = F.col("p_partkey")
    name = F.when(key % 97 != 0, F.col("p_name"))
    template = F.lit(list(TEMPLATES))[(key % len(TEMPLATES)).cast("int")]
    text = F.when(key % 89 != 0, F.replace(template, F.lit("@"), F.col("p_name")))
    lines = [F.when(F.col("p_type") == k, v) for k, v in TYPE_LINES.items()]
    return read_parts(spark, sf_dir).select(
        _card_id(key).alias("id"),
        F.when(key % 7 != 0, F.concat(F.lit("o"), F.floor(key / 2).cast("string"))).alias("oracle_id"),
        name.alias("name"),
        F.date_add(F.lit("2000-01-01").cast("date"), (key % 9000).cast("int"))
        .cast("timestamp")
        .alias("released_at"),
        F.lower("p_type").alias("layout"),
        F.coalesce(*lines).alias("type_line"),
        text.alias("oracle_text"),
        F.col("p_brand").alias("rarity"),
        F.when(key % 13 != 0, (F.col("p_size") % 19) / F.lit(2.0)).alias("cmc"),
        F.when(F.col("p_size") % 5 == 0, "*").otherwise(F.col("p_size").cast("string")).alias("power"),
    )


def demo_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given cluster for nine cards in ten."""
    return (
        read_parts(spark, sf_dir)
        .filter(F.col("p_partkey") % 10 != 9)
        .select(_card_id(F.col("p_partkey")).alias("id"), (F.col("p_size") % 7).alias("cluster"))
    )


def _card_id(key):
    return F.concat(F.lit("c"), F.lpad(key.cast("string"), 12, "0"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    return docs.withColumnRenamed("doc_id", "id")
