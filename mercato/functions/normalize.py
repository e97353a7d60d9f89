"""Normalisation of product rows: category, gender, brand, vertical, sizes, pack quantity, sub-category.

The taxonomy is a parameter: ordered (category, keyword) rules of which the first that a name holds
wins. Keywords are matched as plain substrings of the folded name padded with blanks, so a blank in
a keyword is a word boundary. ``default_rules`` derives a taxonomy from the category names and some
synonyms; shops with larger keyword tables pass their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.text import ACCENTED, PLAIN, blank, fold, site_key, sizes

# Categories of each group, specific before general.
SUPPLEMENTS = ["Creatina", "Barra Proteica", "Pancake Proteico", "Snack Proteico", "Gainer", "Pre-Workout", "Proteína", "Colágeno", "Magnesio", "BCAA", "Vitaminas", "Quemadores", "Suplemento", "Alimentos"]
TECH = ["Notebook", "PC", "Monitor", "GPU", "CPU", "RAM", "Gabinete", "Teclado", "Mouse", "Auricular", "Webcam", "Almacenamiento"]
SHOES = ["Botines", "Borcego", "Pantufla", "Zapato", "Mocasin", "Sandalia", "Ojotas", "Botas", "Zapatilla Running", "Zapatilla Entrenamiento", "Zapatilla Skate", "Zapatilla Urbana", "Sneaker", "Zapatilla"]
UNDERWEAR = ["Calzoncillos", "Corpino", "Malla"]
TORSO = ["Puffer", "Piloto", "Traje", "Saco", "Chaleco", "Campera", "Sweater", "Buzo", "Casaca", "Chomba", "Musculosa", "Camisa", "Remera"]
LEGS = ["Calza", "Baggy", "Jean", "Jogging", "Bermuda", "Short", "Vestido", "Enterito", "Pollera", "Pantalón"]
ACCESSORIES = ["Billetera", "Riñonera", "Mochila", "Bolso", "Cinturón", "Bufanda", "Guantes", "Lentes", "Gorro", "Gorra", "Medias", "Accesorio Deportivo"]
# Words that stand for a category besides its name.
SYNONYMS = {
    "Proteína": ["whey", "protein"], "Proteico": ["protein bar"], "Gainer": ["mass gainer"], "Colágeno": ["collagen"], "Vitaminas": ["vitamina", "multivitaminico"], "Quemadores": ["termogenico"], "BCAA": ["aminoacido"],
    "Notebook": ["laptop"], "GPU": ["placa de video", "geforce", "radeon"], "CPU": ["procesador", "ryzen"], "RAM": ["memoria ddr"], "Auricular": ["headset"], "Almacenamiento": [" ssd ", "disco rigido"],
    "Zapatilla": ["footwear", "calzado"], "Zapatilla Running": ["zapatillas running", "zapatillas de running"], "Botas": ["bota "], "Ojotas": ["ojota", "chinela"], "Sandalia": ["sandals"], "Calzoncillos": ["boxer", "calzoncillo"], "Corpino": ["sosten", "bralette"], "Malla": ["bikini", "traje de bano"],
    "Puffer": ["inflable"], "Piloto": ["impermeable"], "Campera": ["jacket", "rompevientos"], "Sweater": ["pulover"], "Buzo": ["hoodie", "canguro"], "Musculosa": [" top ", "tank"], "Camisa": ["shirt "], "Remera": ["tee ", "camiseta"], "Chomba": [" polo "],
    "Calza": ["legging", "biker"], "Jogging": ["jogger"], "Pollera": ["falda"], "Pantalón": ["pants", "cargo"], "Gorra": [" cap "], "Gorro": ["beanie"], "Medias": ["soquete", "socks"], "Lentes": ["anteojos"], "Bolso": ["cartera", "tote"],
}
# Categories worn by women unless the name says otherwise.
FEMININE = ["Calza", "Pollera", "Vestido", "Enterito", "Corpino", "Malla"]
# Brands, in the order in which they are looked for.
BRANDS = [
    "Nike", "Adidas", "Puma", "Reebok", "New Balance", "Asics", "Saucony", "Brooks", "Hoka", "On Running", "Salomon", "Mizuno", "Under Armour",
    "Fila", "Umbro", "Vans", "Converse", "DC", "Etnies", "Volcom", "Quiksilver", "Billabong", "The North Face", "Columbia", "Patagonia",
    "Timberland", "Merrell", "Topper", "Flecha", "Jaguar", "Gola", "Penalty", "Olympikus", "Lacoste", "Tommy", "Calvin Klein", "Levi's", "Levis",
    "Wrangler", "Champion", "Kappa", "Ellesse", "Le Coq Sportif", "Fred Perry", "Caterpillar", "Keen", "Palladium", "Crocs", "Birkenstock", "Bulks",
    "Fuark", "Harvey Willys", "Harvey", "Gold Nutrition", "Star Nutrition", "Xtrenght", "ENA", "BSA",
]
# Sub-categories of a category by whole words; a sub-category without words is the default.
SUB_CATEGORIES = {
    "Gorro": {"natación": "natacion|swimming|swim cap|pileta", "ski": "ski|snowboard|snowboarding|nieve", "invierno": ""},
    "Malla": {"bikini": "bikini|triangulo|triangular", "entera": "one piece|entera|enteriza", "tankini": "tankini"},
    "Short": {"natación": "natacion|bano|swim", "cargo": "cargo", "gym": "gym|training|entrenamiento|fitness"},
    "Campera": {"outdoor": "hiking|trekking|montana|outdoor|trail", "running": "running|runner", "polar": "polar|fleece", "rompevientos": "rompevientos|cortavientos|cortaviento|wind"},
    "Conjunto": {"deportivo": "deportivo|gym|training|entrenamiento|running|fitness|sport", "interior": "interior|intimo|lenceria", "baño": "bano|swim|natacion"},
    "Calza": {"running": "running|runner", "ciclista": "ciclista|cycling|ciclismo", "térmica": "termica"},
    "Musculosa": {"deportiva": "deportiva|gym|training|entrenamiento|fitness|sport"},
    "Calzoncillos": {"boxer": "boxer", "slip": "slip", "brief": "brief"},
    "Corpino": {"deportivo": "deportivo|training|gym|sport|fitness", "push-up": "push up|pushup|push-up", "triangular": "triangular|triangulo", "bralette": "bralette"},
    "Medias": {"deportivas": "deportivas|sport|running", "compresión": "compresion", "tobilleras": "tobilleras|tobillo"},
    "Buzo": {"hoodie": "hoodie|capucha|canguro"},
    "Bolso": {"tote": "tote", "cartera": "mano|cartera", "mensajero": "mensajero|crossbody"},
    "Mochila": {"trekking": "trekking|hiking|outdoor", "deportiva": "deportiva|gym|sport"},
}
SPORTS = {"natación": "natacion|swimming|swim cap", "hockey": "hockey", "fútbol": "futbol|football", "pádel": "padel", "tenis": "tenis|tennis", "running": "running|runner", "vóley": "voley|volleyball", "básquet": "basket|basketball", "ciclismo": "ciclismo|cycling", "escalada": "escalada|climbing", "snowboarding": "snowboard|snowboarding"}
#: Garments that packs are counted in.
COUNTED = ["remera", "buzo", "musculosa", "camisa", "campera", "chomba", "calza", "jean", "pantalon", "short", "bermuda", "media", "calzoncillo", "boxer"]
MOST_UNITS = 12


def _plain(text: str) -> str:
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN))


def default_rules() -> list[tuple[str, str]]:
    """Ordered rules: early nutrition, sets, electronics, shoes, clothes, nutrition, accessories."""
    short = {"PC", "GPU", "CPU", "RAM", "BCAA", "Saco", "Short", "Traje"}
    word = lambda c: f" {_plain(c)} " if c in short else _plain(c).removesuffix("s") if len(c) > 5 else _plain(c)
    of = lambda cs: [(c, k) for c in cs for k in [word(c), *SYNONYMS.get(c, [])]]
    return [*of(SUPPLEMENTS[:-3]), ("Conjunto", "conjunto"), *of(TECH), *of(SHOES), *of(UNDERWEAR), *of(TORSO), *of(LEGS), *of(SUPPLEMENTS[-3:]), ("Perfume", "perfume"), *of(ACCESSORIES)]


@dataclass(frozen=True)
class Taxonomy:
    rules: tuple[tuple[str, str], ...] = field(default_factory=lambda: tuple(default_rules()))
    not_textile: tuple[str, ...] = ("perfume", "shampoo", "crema", "gel", "vela", "libro", "toalla", "botella")
    brands: tuple[str, ...] = tuple(BRANDS)
    gym_sites: tuple[str, ...] = ("entreno",)
    gym_words: tuple[str, ...] = ("gym", "training", "fitness", "crossfit")
    gym_brands: tuple[str, ...] = ("fuark", "bulks")


def not_textile(name: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands alone within the first 35 characters."""
    return F.concat(F.lit(" "), F.substring(fold(name), 1, 35), F.lit(" ")).rlike("|".join(f" {w} " for w in words))


def _first_rule(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Category of the first rule whose keyword the text holds; the rules are one literal array, so the plan stays small."""
    table = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(k).alias("k")) for c, k in rules])
    padded = F.concat(F.lit(" "), fold(text), F.lit(" "))
    return F.get(F.filter(table, lambda r: F.contains(padded, r["k"])), F.lit(0))["c"]


def category(raw: Column, name: Column, taxonomy: Taxonomy) -> Column:
    """From the name, else from the shop's own category; a weight at the end means food; else Otros."""
    from_name = F.when(~not_textile(name, taxonomy.not_textile), _set_or(name, taxonomy))
    from_raw = F.when(~not_textile(raw, taxonomy.not_textile), _set_or(raw, taxonomy))
    weighs = fold(F.trim(name)).rlike(r"\d+\s*(g|ml|kg|mg|oz|l)\s*$")
    return F.coalesce(from_name, from_raw, F.when(weighs, "Alimentos"), F.lit("Otros"))


def _holds(text: Column, categories: list[str], taxonomy: Taxonomy) -> Column:
    return _first_rule(text, tuple(r for r in taxonomy.rules if r[0] in categories)).isNotNull()


def _set_or(text: Column, taxonomy: Taxonomy) -> Column:
    """A name with a garment for the torso and one for the legs is a set."""
    found = _first_rule(text, taxonomy.rules)
    both = _holds(text, TORSO, taxonomy) & _holds(text, LEGS, taxonomy)
    return F.when(both & ~found.isin(SUPPLEMENTS), "Conjunto").otherwise(found)


def gender(raw: Column, name: Column, cat: Column) -> Column:
    """Children first, then what the name says outright, then what the category and all words suggest."""
    n, all_ = fold(name), F.concat_ws(" ", fold(raw), fold(name))
    man_said = n.rlike("de hombre|para hombre| hombre|masculino|caballero")
    return (
        F.when(all_.rlike("nino|nina|kids|infantil|bebe"), "infantil")
        .when(n.rlike("(de|para) mujer"), "mujer")
        .when(n.rlike("(de|para) hombre"), "hombre")
        .when(cat.isin(FEMININE) & ~man_said, "mujer")
        .when(all_.rlike("hombre|masculino| men|male|caballero|varones"), "hombre")
        .when(all_.rlike("mujer|femenino|women|female|dama"), "mujer")
        .when(all_.rlike("unisex|neutro"), "unisex")
        .when(all_.rlike(r"wmns|w | w\)"), "mujer")
        .when(~blank(raw), F.lower(F.trim(raw)))
        .when(cat == "Calza", "mujer")
        .otherwise("")
    )


def brand(name: Column, brands: tuple[str, ...]) -> Column:
    """The first listed brand that the name holds as whole words; none is an empty text."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(*[F.when(n.rlike(rf"\b\Q{b.lower()}\E\b"), b) for b in brands], F.lit(""))


def vertical(cat: Column, forced: Column, known: Column) -> Column:
    """What sells the product: the site's forced vertical bends to textile categories only."""
    textile = cat.isin([*SHOES, *TORSO, *LEGS, *UNDERWEAR, *ACCESSORIES])
    return (
        F.when((forced == "tecnologia") & ~textile, "tecnologia")
        .when(cat.isin(SUPPLEMENTS), "suplementos")
        .when((forced == "suplementos") & ~textile, "suplementos")
        .when(textile, "indumentaria")
        .when(~blank(known), known)
        .otherwise("indumentaria")
    )


def is_gym(name: Column, key: Column, cat: Column, vert: Column, brand_: Column, taxonomy: Taxonomy) -> Column:
    """Training clothes; never shoes or food."""
    hit = fold(name).rlike("|".join(taxonomy.gym_words)) | F.lower(F.trim(F.coalesce(brand_, F.lit("")))).isin(list(taxonomy.gym_brands)) | key.rlike("|".join(taxonomy.gym_sites))
    return ~cat.isin([*SHOES, "Suplemento", "Alimentos"]) & (vert != "suplementos") & hit


# How packs are written: counted packs, packs times a number, counted pieces, and what looks like a pack but isn't.
PACK = r"\b(?:pack|combo|set|kit)\s*(?:de\s*)?x?\s*(\d{1,2})\b"
PACK_TIMES = r"\b(?:pack|combo|set|kit)\b.{0,20}?\bx\s*(\d{1,2})\b"
PIECES = r"\b(\d{1,2})\s*(?:piezas|prendas|unidades)\b"
NO_PACK = r"\btalle[s]?\s+\d{1,3}\s*(?:-|a|al)\s*\d{1,3}\b|\b\d{1,2}\s*colores\b"


def units(name: Column, taxonomy: Taxonomy) -> Column:
    """Pieces in a pack, 1 to 12: a counted pack, counted garments, counted pieces, or a top joined with a bottom."""
    t = F.concat(F.lit(" "), fold(name), F.lit(" "))
    number = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).try_cast("int")
    plurals = "|".join([*(w + "s" for w in COUNTED if w != "pantalon"), "pantalones"])
    counted = F.coalesce(
        number(PACK),
        number(PACK_TIMES),
        number(rf"\b(\d{{1,2}})\s+(?:{plurals})\b"),
        number(PIECES),
    )
    words = lambda cs: "|".join(k.strip() for c, k in taxonomy.rules if c in cs)
    joined = rf"(?:{words(TORSO)})[^+/]{{0,28}}?(?:\+|/|\by\b|\be\b).{{0,28}}?(?:{words(LEGS)})|(?:{words(LEGS)})[^+/]{{0,28}}?(?:\+|/|\by\b|\be\b).{{0,28}}?(?:{words(TORSO)})"
    vetoed = t.rlike(NO_PACK) | not_textile(name, taxonomy.not_textile)
    return F.when(vetoed, 1).when(counted.isNotNull(), F.when(counted.between(2, MOST_UNITS), counted).otherwise(1)).when(t.rlike(joined), 2).otherwise(1)


def sub_category(name: Column, cat: Column) -> Column:
    """The category's own sub-categories by whole words, then sports; none is an empty text."""
    t = F.concat(F.lit(" "), fold(name), F.lit(" "))
    holds = lambda words: t.rlike(f" (?:{words}) ") if words else F.lit(True)
    own = [F.when((cat == c) & holds(words), sub) for c, subs in SUB_CATEGORIES.items() for sub, words in subs.items()]
    sports = [F.when(holds(words) & (F.lit(sub != "running") | ~F.contains(fold(cat), F.lit("running"))), sub) for sub, words in SPORTS.items()]
    return F.when(blank(name), "").otherwise(F.coalesce(*own, *sports, F.lit("")))


def normalize(rows: DataFrame, taxonomy: Taxonomy | None = None, sites: DataFrame | None = None, categorized: bool = False) -> DataFrame:
    """Normalised rows. ``sites(site_key, forced_vertical)`` is the lookup of sites, joined by Spark as its size allows.

    Each column rests on those before it: category, gender, sizes, brand, vertical, gym, units, sub-category.
    With ``categorized`` the categories are final already, as ``operators.cascade.categorize`` gives them.
    """
    taxonomy = taxonomy or Taxonomy()
    rows = rows.withColumn("site_key", site_key(F.coalesce("site", F.lit(""))))
    rows = rows.join(sites.select("site_key", "forced_vertical"), "site_key", "left") if sites is not None else rows.withColumn("forced_vertical", F.lit(None).cast("string"))
    name = F.col("name")
    if not categorized:
        rows = rows.withColumn("category", category(F.col("category"), name, taxonomy))
    rows = rows.withColumns({"gender": gender(F.col("gender"), name, F.col("category")), "sizes": sizes(F.col("sizes")), "brand": F.when(blank(F.col("brand")), brand(name, taxonomy.brands)).otherwise(F.col("brand"))})
    rows = rows.withColumn("vertical", vertical(F.col("category"), F.col("forced_vertical"), F.col("vertical")))
    rows = rows.withColumns({"gym": is_gym(name, F.col("site_key"), F.col("category"), F.col("vertical"), F.col("brand"), taxonomy), "units": units(name, taxonomy), "sub_category": sub_category(name, F.col("category"))})
    return rows.drop("site_key", "forced_vertical")
