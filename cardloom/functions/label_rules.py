"""The rule table of the labeller, as data, and the label taxonomy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One label with the conditions under which it applies; all must hold.

    ``any_of``  at least one pattern is found      ``also``   at least one of these too
    ``unless``  none of the patterns is found      ``types``  (type, wanted) pairs
    ``words``   at least one literal is contained  ``signals`` no literal is contained
    ``blank``   the text must (True) or must not (False) be blank
    ``hints``   literals one of which every match of ``any_of`` contains; a quick test
                before the patterns that never changes the outcome
    """

    label: str
    confidence: float
    reason: str
    any_of: Sequence[str] = ()
    also: Sequence[str] = ()
    unless: Sequence[str] = ()
    types: Sequence[tuple[str, bool]] = ()
    words: Sequence[str] = ()
    signals: Sequence[str] = ()
    blank: bool | None = None
    hints: Sequence[str] = ()


@dataclass(frozen=True)
class LabelInfo:
    label: str
    category: str
    description: str


RULE_SOURCE = "rule"
FALLBACK_LABEL = "needs_review"
REVIEW_BELOW = 0.60

# Keyword and signal literals, patterns, confidences and reasons.
KEYWORDS = (
    "flying", "trample", "vigilance", "haste", "lifelink", "deathtouch",
    "menace", "reach", "first strike", "double strike", "hexproof",
    "indestructible", "defender", "flash", "ward", "prowess",
)

SIGNALS = (
    "when ", "whenever ", "at the beginning", ":", "draw", "create",
    "destroy", "exile target", "return target", "search your library",
)

MANA_PATTERNS = (
    r"\badd\s+\{[^}]+\}",
    r"\badd (one|two|three|x|an amount of|.*) mana\b",
)

RULES: tuple[Rule, ...] = (
    Rule("vanilla_creature", 0.95, "Creature with no oracle text.",
         types=(("creature", True),), blank=True),
    Rule("french_vanilla_creature", 0.70, "Creature text appears mostly keyword-based.",
         types=(("creature", True),), blank=False, words=KEYWORDS, signals=SIGNALS),
    Rule("land_ramp", 0.90, "Searches for or puts lands onto the battlefield.",
         any_of=(r"search your library for .* land", r"put .* land .* onto the battlefield"),
         hints=("search your library for ", "onto the battlefield")),
    Rule("mana_dork", 0.90, "Creature that produces mana.",
         types=(("creature", True),), any_of=MANA_PATTERNS,
         hints=("add",)),
    Rule("mana_rock", 0.90, "Artifact that produces mana.",
         types=(("creature", False), ("artifact", True)), any_of=MANA_PATTERNS,
         hints=("add",)),
    Rule("ritual", 0.75, "Noncreature/nonartifact spell or permanent produces mana.",
         types=(("creature", False), ("artifact", False)), any_of=MANA_PATTERNS,
         hints=("add",)),
    Rule("cost_reducer", 0.85, "Reduces spell costs.",
         any_of=(r"spells? you cast cost .* less", r"costs? \{\d+\} less to cast"),
         hints=(" you cast cost ", " less to cast")),
    Rule("card_draw", 0.85, "Draws cards.",
         any_of=(r"\bdraw (a|one|two|three|four|x|\d+) cards?\b",),
         hints=("draw ",)),
    Rule("impulse_draw", 0.85, "Exiles cards from library and allows casting/playing them.",
         any_of=(r"exile .* (top|from the top) .* library",), also=(r"you may (cast|play)",),
         hints=(" library",)),
    Rule("loot", 0.85, "Draw then discard effect.",
         any_of=(r"draw .* cards?.*discard", r"draw a card,? then discard"),
         hints=("draw ",)),
    Rule("rummage", 0.85, "Discard then draw effect.",
         any_of=(r"discard .* cards?.*draw", r"discard a card,? then draw"),
         hints=("discard ",)),
    Rule("targeted_removal_destroy", 0.85, "Destroys a target.",
         any_of=(r"\bdestroy target\b",),
         hints=("destroy target",)),
    Rule("targeted_removal_exile", 0.85, "Exiles a target.",
         any_of=(r"\bexile target\b",),
         hints=("exile target",)),
    Rule("targeted_removal_bounce", 0.85, "Returns a target permanent/spell to hand.",
         any_of=(r"\breturn target .* to (its owner's )?hand\b",),
         hints=("return target ",)),
    Rule("counterspell", 0.90, "Counters a spell or ability.",
         any_of=(r"\bcounter target (spell|activated ability|triggered ability)\b",),
         hints=("counter target ",)),
    Rule("board_wipe", 0.80, "Mass removal or affects all/every creature.",
         any_of=(r"\bdestroy all\b|\bexile all\b|\beach creature\b|\ball creatures\b",),
         hints=("destroy all", "exile all", "each creature", "all creatures")),
    Rule("pump_spell", 0.85, "Temporarily increases creature power/toughness.",
         any_of=(r"target creature gets \+\d/\+\d", r"gets \+\d/\+\d until end of turn"),
         hints=("target creature gets +", " until end of turn")),
    Rule("debuff_spell", 0.85, "Temporarily decreases creature power/toughness.",
         any_of=(r"target creature gets -\d/-\d", r"gets -\d/-\d until end of turn"),
         hints=("target creature gets -", " until end of turn")),
    Rule("anthem", 0.85, "Buffs multiple creatures you control.",
         any_of=(r"creatures you control get \+\d/\+\d", r"other creatures you control get"),
         hints=("creatures you control get",)),
    Rule("token_maker", 0.90, "Creates tokens.",
         any_of=(r"\bcreate .* token", r"\bcreate .* (treasure|clue|food|blood|map)"),
         hints=("create ",)),
    Rule("sac_outlet", 0.85, "Sacrifice appears as an activated cost.",
         words=(":",),
         any_of=(r"sacrifice (a|another|any number of|one or more|this|[a-z ]+)",),
         hints=("sacrifice ",)),
    Rule("sac_payoff", 0.80, "Rewards sacrifice or death events.",
         any_of=(r"whenever you sacrifice", r"whenever .* (dies|is put into a graveyard)"),
         hints=("whenever ",)),
    Rule("discard_outlet", 0.85, "Discard appears as an activated cost.",
         any_of=(r"discard a card:|discard .* cards?:",),
         hints=("discard ",)),
    Rule("discard_payoff", 0.85, "Rewards discard events.",
         any_of=(r"whenever (you|an opponent|a player) discards",
                 r"opponent.*discard.*loses life"),
         hints=("whenever ", "opponent")),
    Rule("mill", 0.85, "Moves cards from library to graveyard.",
         any_of=(r"\bmill\b", r"puts? the top .* cards? .* into .* graveyard"),
         hints=("mill", " the top ")),
    Rule("graveyard_payoff", 0.75, "Uses or benefits from graveyard contents.",
         any_of=(r"from your graveyard|in your graveyard|cards? in graveyards"
                 r"|escape|flashback|delve|threshold",),
         hints=("your graveyard", " in graveyards", "escape", "flashback", "delve", "threshold")),
    Rule("reanimation", 0.90, "Returns cards from graveyard to battlefield.",
         any_of=(r"return target .* card from your graveyard to the battlefield",
                 r"return .* from your graveyard to the battlefield"),
         hints=(" from your graveyard to the battlefield",)),
    Rule("blink_enabler", 0.90, "Exiles and returns permanents.",
         any_of=(r"exile target .* you control.*return", r"exile .* then return .* battlefield"),
         hints=("exile ",)),
    Rule("lifegain_payoff", 0.90, "Rewards life gain.",
         any_of=(r"whenever you gain life|if you gained life|each time you gain life",),
         hints=("gain life", "gained life")),
    Rule("group_hug_draw", 0.85, "Lets multiple players draw cards.",
         any_of=(r"each player draws|each opponent draws|players draw",),
         hints=(" draw",)),
    Rule("group_hug_ramp", 0.85, "Lets multiple players ramp.",
         any_of=(r"each player may search .* land", r"each player.*put .* land .* battlefield"),
         hints=("each player",)),
    Rule("tutor", 0.85, "Searches library for a nonland card.",
         any_of=(r"search your library for .* card",), unless=(r"land card|basic land",),
         hints=("search your library for ",)),
    Rule("stax_piece", 0.75, "Restricts actions, resources, untapping, casting, or combat.",
         any_of=(r"can't cast|can't attack|can't block|doesn't untap|skip .* step"
                 r"|spells cost .* more|players can't|opponents can't",),
         hints=("can't", "doesn't untap", "skip ", "spells cost ")),
    Rule("protection", 0.80, "Protects permanents or players.",
         any_of=(r"gain hexproof|gains hexproof|indestructible until end|gains indestructible"
                 r"|protection from|prevent all damage|phase out",),
         hints=("hexproof", "indestructible", "protection from", "prevent all damage", "phase out")),
)

FALLBACK = Rule(FALLBACK_LABEL, 0.30, "No confident rule label matched.")

# The label taxonomy.

TAXONOMY: tuple[LabelInfo, ...] = (
    LabelInfo("vanilla_creature", "card_role",
              "Creature with no rules text beyond possible flavor/reminder absence."),
    LabelInfo("french_vanilla_creature", "card_role",
              "Creature whose text is mostly keyword abilities."),
    LabelInfo("land_ramp", "card_role", "Card that searches the library for lands."),
    LabelInfo("ritual", "card_role", "Card that adds mana when cast."),
    LabelInfo("mana_dork", "card_role", "Creature that produces mana."),
    LabelInfo("mana_rock", "card_role", "Artifact that produces mana."),
    LabelInfo("cost_reducer", "card_role", "Reduces the mana cost of other spells."),
    LabelInfo("card_draw", "card_role", "Card that draws cards."),
    LabelInfo("impulse_draw", "card_role", "Card that exiles cards from the library to be cast."),
    LabelInfo("loot", "card_role", "Draw then discard style card selection."),
    LabelInfo("rummage", "card_role", "Discard then draw style card selection."),
    LabelInfo("targeted_removal_destroy", "card_role", "Destroys a target permanent."),
    LabelInfo("targeted_removal_exile", "card_role", "Exiles a target permanent."),
    LabelInfo("targeted_removal_bounce", "card_role", "Returns a target permanent to hand."),
    LabelInfo("board_wipe", "card_role",
              "Mass removal affecting many permanents or creatures."),
    LabelInfo("counterspell", "card_role", "Counters spells or abilities."),
    LabelInfo("pump_spell", "card_role",
              "Temporarily increases target creature's power/toughness."),
    LabelInfo("debuff_spell", "card_role",
              "Temporarily decreases target creature's power/toughness."),
    LabelInfo("anthem", "card_role",
              "Static or recurring effect that buffs multiple creatures."),
    LabelInfo("token_maker", "card_role",
              "Creates creature, artifact, treasure, clue, food, or other tokens."),
    LabelInfo("sac_outlet", "card_role",
              "Allows sacrificing permanents as a cost or repeatable action."),
    LabelInfo("sac_payoff", "card_role", "Rewards permanents dying or being sacrificed."),
    LabelInfo("discard_outlet", "card_role",
              "Allows the controller to discard cards for value or as a cost."),
    LabelInfo("discard_payoff", "card_role",
              "Rewards opponents or players discarding cards."),
    LabelInfo("mill", "card_role",
              "Card that moves other cards from the library to the graveyard."),
    LabelInfo("graveyard_payoff", "card_role",
              "Benefits from graveyard contents or cards leaving graveyards."),
    LabelInfo("reanimation", "card_role",
              "Returns creature or permanent cards from graveyard to battlefield."),
    LabelInfo("blink_enabler", "card_role",
              "Exiles and returns permanents to reuse ETB/LTB effects."),
    LabelInfo("lifegain_payoff", "card_role", "Rewards gaining life."),
    LabelInfo("group_hug_draw", "card_role", "Lets multiple players draw cards."),
    LabelInfo("group_hug_ramp", "card_role", "Lets multiple players ramp."),
    LabelInfo("tutor", "card_role", "Searches library for a specific card or card type."),
    LabelInfo("stax_piece", "card_role",
              "Restricts actions, resources, untapping, casting, or combat."),
    LabelInfo("protection", "card_role",
              "Protects permanents or players through hexproof, indestructible, prevention, "
              "or similar effects."),
    LabelInfo("needs_review", "needs_review",
              "Card could not be confidently labeled or has ambiguous text."),
)
