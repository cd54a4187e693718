"""Which URLs of a site are kept: rules for each top-level category as one predicate over one scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import urls


@dataclass(frozen=True)
class Rule:
    """For one category: values of levels that are needed or excluded, excluded URLs, and where excluded words may not stand."""

    include: dict[int, tuple[str, ...]] = field(default_factory=dict)
    exclude: dict[int, tuple[str, ...]] = field(default_factory=dict)
    exclude_urls: tuple[str, ...] = ()
    banned_in: tuple[str | int, ...] = ()  # "url" or levels

    def keeps(self, url: Column, banned: str | None, level=urls.level) -> Column:
        tests = [level(url, n).isin(*v) for n, v in self.include.items()]
        tests += [~level(url, n).isin(*v) for n, v in self.exclude.items()]
        if self.exclude_urls:
            tests.append(~url.isin(*self.exclude_urls))
        if banned:
            tests += [~F.coalesce((url if w == "url" else level(url, w)).rlike(banned), F.lit(False)) for w in self.banned_in]
        return reduce(Column.__and__, tests, F.lit(True))


def kept(url: Column, rules: dict[str, Rule], banned_words: tuple[str, ...] = ()) -> Column:
    """Whether a URL's category has a rule that keeps it; URLs of other categories are not kept."""
    banned = "|".join("\\Q" + w + "\\E" for w in banned_words) or None
    tests = [(urls.level(url, 1) == name) & rule.keeps(url, banned) for name, rule in rules.items()]
    return F.coalesce(reduce(Column.__or__, tests, F.lit(False)), F.lit(False))


def filter_urls(links: DataFrame, rules: dict[str, Rule], banned_words: tuple[str, ...] = (), url_col: str = "url") -> DataFrame:
    return links.filter(kept(F.col(url_col), rules, banned_words))


def discover(sitemaps: DataFrame, rules: dict[str, Rule], banned_words: tuple[str, ...] = (), url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """The links that a site's rules keep, and how many there are of each first level; raises where a slug could not give a URL back."""
    links = check_slugs(filter_urls(sitemaps, rules, banned_words, url_col), url_col)
    return links, links.groupBy(urls.level(F.col(url_col), 1).alias("level_1")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level_1")


def check_slugs(links: DataFrame, url_col: str = "url") -> DataFrame:
    """``links`` itself; raises if a URL holds ``__``, which its slug could not give back."""
    bad = links.filter(F.contains(F.col(url_col), F.lit("__"))).limit(5).collect()
    if bad:
        raise EngineError(f"URLs with a literal __: {[r[url_col] for r in bad]}")
    return links


# The rules of one rulebook site.
_SITE = "https://www.d20pfsrd.com"
THIRD_PARTY = (
    "3rd-party-publisher", "3rd-party-publishers", "4-winds-fantasy-gaming", "adamant-entertainment", "ascension-games", "ascension-games-llc",
    "azoth-games", "bloodstone-press", "d20pfsrd-com-publishing", "dreamscarred-press", "drop-dead-studios", "everyman-gaming", "everyman-gaming-llc",
    "far-distant-future-publishing", "fat-goblin-games", "fire-mountain-games", "flaming-crab-games", "flying-pincushion-games",
    "forest-guardian-press", "frog-god-games", "icosa-entertainment-llc", "jon-brazer-enterprises", "jon-brazer-enterprizes", "kobold-press",
    "kobold-press-open-design-llc", "legendary-games", "little-red-goblin-games", "little-red-goblin-games-llc", "louis-porter-jr-design",
    "michael-mars", "misfit-studios", "names-games", "necromancers-of-the-northwest", "onyx-path-and-nocturnal-publishing",
    "orphaned-bookworm-productions", "paizo-fans-united", "petersen-games", "purple-duck-games", "radiance-house", "rite-publishing",
    "rogue-genius-games", "samurai-sheepdog", "shm-publishing", "spes-magna-games", "studio-m", "the-knotty-works", "total-party-kill-games",
    "varyags-forge", "xoth-net-publishing", "james-ray", "librarians-leviathans", "arcanist-exploits-3rd-party", "3rd-party", "3pp",
)
SITE_RULES = {
    "alignment-description": Rule(exclude={2: ("",)}),
    "basics-ability-scores": Rule(exclude_urls=(f"{_SITE}/basics-ability-scores/", f"{_SITE}/basics-ability-scores/more-character-options/")),
    "bestiary": Rule(
        exclude={2: ("bestiary-alphabetical", "bestiary-by-challenge-rating", "bestiary-by-terrain", "bestiary-hub", "fan-conversions", "indexes-and-tables", "tools")},
        exclude_urls=(
            f"{_SITE}/bestiary/", f"{_SITE}/bestiary/rules-for-monsters/", f"{_SITE}/bestiary/rules-for-monsters/monster-roles/",
            f"{_SITE}/bestiary/rules-for-monsters/creature-types/new-creature-subtypes/", f"{_SITE}/bestiary/rules-for-monsters/universal-monster-rules/umr-3pp-frog-god-games/",
            f"{_SITE}/bestiary/unique-monsters/", f"{_SITE}/bestiary/unique-monsters/under-cr-1/", f"{_SITE}/bestiary/npc-s/npc-db/", f"{_SITE}/bestiary/monster-listings/",
            f"{_SITE}/classes/", f"{_SITE}/classes/core-classes/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-1/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-2/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-3/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-4/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-5/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-6/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-7/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-8/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-9/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-10/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-11/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-12/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-13/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-14/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-15/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-16/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-17/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-18/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-19/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-20/",
            f"{_SITE}/bestiary/npc-s/npcs-cr-21/",
            f"{_SITE}/bestiary/unique-monsters/cr-1/",
            f"{_SITE}/bestiary/unique-monsters/cr-2/",
            f"{_SITE}/bestiary/unique-monsters/cr-3/",
            f"{_SITE}/bestiary/unique-monsters/cr-4/",
            f"{_SITE}/bestiary/unique-monsters/cr-5/",
            f"{_SITE}/bestiary/unique-monsters/cr-6/",
            f"{_SITE}/bestiary/unique-monsters/cr-7/",
            f"{_SITE}/bestiary/unique-monsters/cr-8/",
            f"{_SITE}/bestiary/unique-monsters/cr-9/",
            f"{_SITE}/bestiary/unique-monsters/cr-10/",
            f"{_SITE}/bestiary/unique-monsters/cr-11/",
            f"{_SITE}/bestiary/unique-monsters/cr-12/",
            f"{_SITE}/bestiary/unique-monsters/cr-13/",
            f"{_SITE}/bestiary/unique-monsters/cr-14/",
            f"{_SITE}/bestiary/unique-monsters/cr-15/",
            f"{_SITE}/bestiary/unique-monsters/cr-16/",
            f"{_SITE}/bestiary/unique-monsters/cr-17/",
            f"{_SITE}/bestiary/unique-monsters/cr-18/",
            f"{_SITE}/bestiary/unique-monsters/cr-19/",
            f"{_SITE}/bestiary/unique-monsters/cr-20/",
            f"{_SITE}/bestiary/unique-monsters/cr-21/",
            f"{_SITE}/bestiary/unique-monsters/cr-22/",
            f"{_SITE}/bestiary/unique-monsters/cr-23/",
            f"{_SITE}/bestiary/unique-monsters/cr-24/",
            f"{_SITE}/bestiary/unique-monsters/cr-25/",
        ),
        banned_in=("url",),
    ),
    "classes": Rule(
        include={2: ("core-classes", "", "alternate-classes", "base-classes", "character-advancement", "class-archetypes", "hybrid-classes", "monster-classes", "npc-classes", "prestige-classes", "unchained-classes", "ex-class-archetypes")},
        exclude={
            3: ("3rd-party-alternate-classes", "3rd-party-hybrid-classes", "hill-giant-monster-class", "lizardfolk-monster-class", "astral-deva"),
            4: (
                "3rd-party-shaman-spirits", "arcanist-greater-exploits", "archetypes-bloodstone-press", "archetypes-orphaned-bookworm-productions-2", "fighter-bravery-alternative-options",
                "gods-3rd-party-publishers", "hexes-3rd-party-publishers", "unchained-barbarian-archetypes-shm-publishing", "vampire-hunter-archetypes-legendary-games", "witch-patrons-3rd-party-publishers",
            ),
            6: ("animal-companion-archetypes-by-other-publishers",),
        },
        banned_in=(5,),
    ),
    "equipment": Rule(exclude={2: ("3rd-party-equipment", "special-materials-third-party")}, banned_in=("url",)),
    "feats": Rule(banned_in=("url",)),
    "gamemastering": Rule(exclude={2: ("tools",)}, banned_in=(3, 4)),
    "magic": Rule(
        exclude={2: ("tools",)},
        exclude_urls=(
            f"{_SITE}/magic/all-spells/",
            f"{_SITE}/magic/spell-lists-and-domains/",
            f"{_SITE}/magic/tools/",
            f"{_SITE}/magic/variant-magic-rules/",
            f"{_SITE}/magic/all-spells/a/",
            f"{_SITE}/magic/all-spells/b/",
            f"{_SITE}/magic/all-spells/c/",
            f"{_SITE}/magic/all-spells/d/",
            f"{_SITE}/magic/all-spells/e/",
            f"{_SITE}/magic/all-spells/f/",
            f"{_SITE}/magic/all-spells/g/",
            f"{_SITE}/magic/all-spells/h/",
            f"{_SITE}/magic/all-spells/i/",
            f"{_SITE}/magic/all-spells/j/",
            f"{_SITE}/magic/all-spells/k/",
            f"{_SITE}/magic/all-spells/l/",
            f"{_SITE}/magic/all-spells/m/",
            f"{_SITE}/magic/all-spells/n/",
            f"{_SITE}/magic/all-spells/o/",
            f"{_SITE}/magic/all-spells/p/",
            f"{_SITE}/magic/all-spells/q/",
            f"{_SITE}/magic/all-spells/r/",
            f"{_SITE}/magic/all-spells/s/",
            f"{_SITE}/magic/all-spells/t/",
            f"{_SITE}/magic/all-spells/u/",
            f"{_SITE}/magic/all-spells/v/",
            f"{_SITE}/magic/all-spells/w/",
            f"{_SITE}/magic/all-spells/x/",
            f"{_SITE}/magic/all-spells/y/",
            f"{_SITE}/magic/all-spells/z/",
            f"{_SITE}/magic/all-spells/spells-a-d/",
            f"{_SITE}/magic/all-spells/spells-e-h/",
            f"{_SITE}/magic/all-spells/spells-i-l/",
            f"{_SITE}/magic/all-spells/spells-m-p/",
            f"{_SITE}/magic/all-spells/spells-q-t/",
            f"{_SITE}/magic/all-spells/spells-u-z/",
        ),
        banned_in=("url",),
    ),
    "magic-items": Rule(exclude_urls=(f"{_SITE}/magic-items/magic-items-db/",), banned_in=("url",)),
    "races": Rule(banned_in=("url",)),
    "skills": Rule(exclude_urls=(f"{_SITE}/skills/skills-from-other-publishers/",), banned_in=("url",)),
    "traits": Rule(exclude={2: ("campaign-traits", "tools")}, banned_in=("url",)),
}
