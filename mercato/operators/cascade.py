"""Categories of product texts by a cascade of keyword groups.

A text is folded, padded with blanks and looked up in a keyword table: every three letters of it
are joined with the three letters that keywords begin with, and what a keyword's letters really stand in
counts. So a text meets the few keywords that may be in it, however large the table is. The groups that were hit
are bits of one row per different text; the cascade is a list of steps over them, of which the
first that holds gives the category. A step may ask for hits of several groups together and for none of others,
so guards are steps like any other.

The keyword table is a parameter; ``default_keywords`` holds the library's own taxonomy and the short lists that guards need.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.normalize import ACCESSORIES, LEGS, SHOES, SUPPLEMENTS, TECH, TORSO, UNDERWEAR, default_rules
from mercato.functions.text import blank, fold

#: Letters by which texts and keywords meet, and rows of a keyword table that is broadcast; a larger one is joined by shuffle.
ANCHOR, SMALL_ROWS = 3, 200_000
BITS = 62

# Words that only count near others, and those others; names of foods that come before clothes.
GUARD_WORDS = {
    "boot line": ["ace", "copa", "tiempo", "future"],
    "football": ["botin", "futbol", "tachon", "cleats", "cancha"],
    "work boot brand": ["timberland"],
    "work boot": ["borcego", "bota", "boot", "hiker", "hiking", "calzado"],
    "flip-flop brand": ["reef "],
    "flip-flop": ["ojota", "sandalia", "chancla", "chinelo", "slide", "flip flop", "zueco", "rasteira", "babucha"],
    "polo": ["polo "],
    "set": ["conjunto", "combo", "set ", "set de", "kit ", "pack ", "dos piezas", "2 piezas"],
    "food": ["salsa ", "ketchup", "mostaza ", "mayonesa", "vinagre ", "mermelada ", "pudding", "chia "],
    "shoe": ["zapatilla", "sneaker", "calzado", " shoe ", "tenis", "footwear"],
    "running": ["running", "correr", "maraton", "trail"],
    "training": ["crossfit", "training", "gym", "funcional"],
    "skate": ["skate"],
    "street": ["urbana", "casual", "lifestyle", "street"],
    "retro": ["retro", "limited", "sneaker"],
}
# A shop's own category words and what they mean here.
ALIASES = {
    "abrigos": "Campera", "coat": "Campera", "bufandon": "Bufanda", "remeron": "Remera", "mini": "Bolso", "neceser": "Bolso", "pc": "PC", "porta": "Otros", "cooling": "Otros", "tarjetas": "Otros", "indumentaria": "Otros",
}
# Words of which one alone near the beginning says that a text names no clothes.
NOT_TEXTILE = [
    "pelota", "balon", "ball", "palo", "stick", "raqueta", "bate", "arco", "red", "valla", "cono", "bolsa deportiva", "costurero", "guantes boxing", "guantes portero", "casco bici", "casco skate",
    "cadena", "collar", "pulsera", "anillo", "aros", "aro", "colgante", "brazalete", "tobillera joya", "piercing", "broche", "maletin", "valija", "paraguas", "baston", "cinturon portaherramientas",
    "crema", "locion", "gel", "shampoo", "jabon", "protector solar", "router", "teclado mecanico", "mouse gamer", "monitor led", "fuente atx",
]
WEIGHT = r"(?i)\d+\s*(g|ml|kg|mg|oz|l)\s*$"
START = 35
#: Shoe categories that only the last steps give.
KINDS = {"running": "Zapatilla Running", "training": "Zapatilla Entrenamiento", "skate": "Zapatilla Skate", "street": "Zapatilla Urbana", "retro": "Sneaker"}


@dataclass(frozen=True)
class Step:
    """``category`` for texts that hold a keyword of some group of every one of ``needs`` and of no group in ``lacks``."""

    category: str
    needs: tuple[tuple[str, ...], ...]
    lacks: tuple[str, ...] = ()


def default_keywords() -> list[tuple[str, str]]:
    """(group, keyword): a group for each category, and those that guards ask for."""
    late = {*KINDS.values(), "Zapatilla", "Conjunto"}
    guarded = {("Chomba", " polo ")}
    return [*((c, k) for c, k in default_rules() if c not in late and (c, k) not in guarded), *((g, k) for g, words in GUARD_WORDS.items() for k in words)]


def default_steps() -> tuple[Step, ...]:
    """Foods, sets, electronics, shoes, clothes, nutrition, accessories, then shoes that only their use names."""
    one = lambda cs: [Step(c, ((c,),)) for c in cs]
    nutrition = [Step(c, ((c,),)) for c in SUPPLEMENTS]
    guards = {
        "Botines": Step("Botines", (("boot line",), ("football",))),
        "Borcego": Step("Borcego", (("work boot brand",), ("work boot",))),
        "Ojotas": Step("Ojotas", (("flip-flop brand",), ("flip-flop",))),
        "Chomba": Step("Chomba", (("polo",),), tuple(c for c in ACCESSORIES if c not in ("Riñonera", "Accesorio Deportivo"))),
    }
    named = [c for c in SHOES if c not in KINDS.values() and c != "Zapatilla"]
    return (
        *(Step(s.category, (("food",), *s.needs)) for s in nutrition),
        Step("Alimentos", (("food",),)),
        Step("Conjunto", (("set",),)),
        Step("Conjunto", (tuple(c for c in TORSO if c != "Traje"), tuple(LEGS))),
        *one(TECH),
        *(s for c in [*named, *UNDERWEAR, *TORSO] for s in (*one([c]), *([guards[c]] if c in guards else []))),
        *one(LEGS),
        *nutrition,
        *one(["Perfume", *ACCESSORIES]),
        Step("Alimentos", (("shoe",), ("weight",))),
        *(Step(c, (("shoe",), (g,))) for g, c in KINDS.items()),
        Step("Zapatilla", (("shoe",),)),
    )


@dataclass(frozen=True)
class Cascade:
    steps: tuple[Step, ...] = field(default_factory=default_steps)
    aliases: dict[str, str] = field(default_factory=lambda: dict(ALIASES))
    not_textile: tuple[str, ...] = tuple(NOT_TEXTILE)
    #: Words of shops' names that their categories may hold.
    shops: tuple[str, ...] = ()

    @property
    def groups(self) -> list[str]:
        return list(dict.fromkeys(g for s in self.steps for g in (*(g for n in s.needs for g in n), *s.lacks)))


def keyword_table(like: DataFrame, keywords: list[tuple[str, str]] | None = None) -> DataFrame:
    """``group, keyword`` rows in the session of ``like``."""
    return like.sparkSession.createDataFrame(keywords or default_keywords(), "group string, keyword string")


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), fold(text), F.lit(" "))


def group_hits(texts: DataFrame, keywords: DataFrame, groups: list[str]) -> DataFrame:
    """``text, hits`` of different texts: bits of the groups of which a text holds a keyword, in lists of ``BITS`` each.

    Null texts are left out; repeated keywords count once; keywords that are empty or of other groups never hit.
    """
    number = {g: k for k, g in enumerate(groups)}
    names = _table(texts, [(g, k // BITS, 1 << (k % BITS)) for g, k in number.items()], "group string, word int, bit long")
    known = keywords.join(F.broadcast(names), "group").where(F.length("keyword") > 0).select("keyword", "word", "bit")
    known = known.groupBy("keyword", "word").agg(F.bit_or("bit").alias("bit"))
    shortest, n = known.agg(F.min(F.length("keyword")), F.count("*")).first()
    size = min(ANCHOR, shortest or ANCHOR)
    known = known.withColumn("anchor", F.substring("keyword", 1, size))
    known = F.broadcast(known) if n <= SMALL_ROWS else known
    text = texts.where("text is not null").select("text").distinct().withColumn("padded", padded(F.col("text")))
    anchors = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("padded") - size + 1, F.lit(1))), lambda i: F.col("padded").substr(i, F.lit(size))))
    met = text.withColumn("anchor", F.explode(anchors)).join(known, "anchor", "left")
    held = F.when(F.contains("padded", F.col("keyword")), F.col("bit")).otherwise(F.lit(0).cast("long"))
    words = range((len(groups) + BITS - 1) // BITS)
    hits = met.groupBy("text").agg(*(F.bit_or(F.when(F.col("word") == w, held).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words))
    return hits.select("text", F.array(*(f"w{w}" for w in words)).alias("hits"))


def _table(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def _holds(hits: Column, names: tuple[str, ...], number: dict[str, int], weighs: Column) -> Column:
    masks: dict[int, int] = {}
    for g in names:
        if g != "weight":
            masks[number[g] // BITS] = masks.get(number[g] // BITS, 0) | 1 << (number[g] % BITS)
    found = [F.get(hits, F.lit(w)).bitwiseAND(F.lit(m)) != 0 for w, m in masks.items()]
    found += [weighs] if "weight" in names else []
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def classified(texts: DataFrame, keywords: DataFrame, cascade: Cascade) -> DataFrame:
    """``text, category`` of different texts; null where no step holds or the text's beginning names no clothes."""
    groups = [g for g in cascade.groups if g != "weight"]
    number = {g: k for k, g in enumerate(groups)}
    words = "|".join(cascade.not_textile)
    vetoed = F.substring(fold("text"), 1, START).rlike(rf"(?:^| )(?:{words}) |^(?:{words})\z") if words else F.lit(False)
    weighs = F.trim("text").rlike(WEIGHT)
    chain = F.when(vetoed | blank(F.col("text")), None)
    for step in cascade.steps:
        held = F.lit(True)
        for need in step.needs:
            held = held & _holds(F.col("hits"), need, number, weighs)
        if step.lacks:
            held = held & ~_holds(F.col("hits"), step.lacks, number, weighs)
        chain = chain.when(held, step.category)
    return group_hits(texts, keywords, groups).select("text", chain.cast("string").alias("category"))


def categorize(rows: DataFrame, keywords: DataFrame | None = None, cascade: Cascade | None = None, name: str = "name", raw: str = "category", to: str = "category") -> DataFrame:
    """``rows`` with the category ``to``: by the name, else by the shop's own category, its alias, a weight at the name's end; else Otros.

    Each different text is classified once, so repeated names cost a join. Nulls and blanks name nothing.
    """
    cascade = cascade or Cascade()
    keywords = keyword_table(rows, list(default_keywords())) if keywords is None else keywords
    of = classified(rows.select(F.explode(F.array_distinct(F.array(name, raw))).alias("text")), keywords, cascade)
    rows = rows.withColumns({"__name": F.col(name), "__raw": F.col(raw)})
    rows = rows.join(of.select(F.col("text").alias("__name"), F.col("category").alias("__by_name")), "__name", "left")
    rows = rows.join(of.select(F.col("text").alias("__raw"), F.col("category").alias("__by_raw")), "__raw", "left")
    shops = F.regexp_replace("__raw", rf"(?i)\b({'|'.join(cascade.shops)})\b", "") if cascade.shops else F.col("__raw")
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(shops, r"[>|/\\]+", " "), r"\s{2,}", " "))
    alias = F.create_map(*(F.lit(x) for pair in cascade.aliases.items() for x in pair)) if cascade.aliases else F.lit(None).cast("map<string,string>")
    known = F.coalesce(alias[F.lower(F.get(F.split(cleaned, r"\s+"), F.lit(0)))], alias[F.lower(cleaned)])
    weighs = F.when(F.trim("__name").rlike(WEIGHT), "Alimentos")
    return rows.withColumn(to, F.coalesce("__by_name", "__by_raw", F.when(~blank(F.col("__raw")), known), weighs, F.lit("Otros"))).drop("__name", "__raw", "__by_name", "__by_raw")
